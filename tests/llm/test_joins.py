"""Set joins, vector codes and hard negatives against brute force, with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import cover_tree, hard_negatives, metric_tree, set_join, vector_codes

# ---- set join ----


def set_texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = prose(60)
    out = [" ".join(prose(rng.randint(1, 120))) for _ in range(40)]
    out += [" ".join(shared + prose(rng.randint(3, 40))) for _ in range(30)]
    # families of near copies: every pair of one is near the limit
    for size, edits in ((60, 2), (12, 4), (5, 1)):
        base = prose(100)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    out += [out[3], out[3].upper(), out[5].replace(" ", "\n\t ", 2), "", None, " \t\n", "one", "ONE", "one two", "two one", "a b c d", "a  b c D", "é É", "x " * 30, "x " * 31]
    return out


def brute_sets(rows, k=4, percent=85):
    def of(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = [of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("tile", [256, 8])
def test_set_join(spark, monkeypatch, tile):
    """With small tiles the same groups go through several tiles and their comparison across."""
    monkeypatch.setattr(set_join, "TILE", tile)
    rows = list(enumerate(set_texts()))
    random.Random(1).shuffle(rows)
    rows += [rows[0], (None, rows[1][1]), (None, None), (None, "alone with no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "set": F.lit(1), "tokens": F.lit(None), "component_id": F.lit(0)}).repartition(3)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.join_sets(docs).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute_sets(rows)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert max(sum(w[2] == c for w in want) for c in {w[2] for w in want}) > 40


def test_set_join_edges(spark):
    assert set_join.join_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    unlike = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, set_join.join_sets(unlike).collect())) == [(1, 3, 1), (2, 3, 2), (3, 0, 3)]


def test_overlaps_are_summed_over_fragments():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))) for _ in range(20)]
    total = np.zeros((20, 20))
    for low, high in ((0, 50), (50, 51), (51, 300)):
        part = [s[(s >= low) & (s < high)] for s in sets]
        slots, tokens = np.repeat(np.arange(20), [len(p) for p in part]), np.concatenate(part)
        total += set_join._products(tokens, slots, 20, None, None, 20, columns=16)
        assert (set_join._products(tokens, slots, 20, tokens, slots, 20) >= 0).all()
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    np.fill_diagonal(want, 0), np.fill_diagonal(total, 0)
    assert (total == want).all()


# ---- vector codes ----


def vectors(n, d=16, seed=3):
    """Clustered vectors with repeated rows, equal parts, and rows that must not count."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (7, d))
    x = centres[rng.integers(0, 7, n)] + rng.normal(0, 0.08, (n, d))
    x[n // 2 : n // 2 + 20] = x[n // 2]
    rows = [(int(k) * 3 - 20, [float(v) for v in r.astype(np.float32)], int(k) % 4 if k % 11 else None) for k, r in enumerate(x)]
    rows += [(5000, None, 1), (5001, [None] + [0.1] * (d - 1), 1), (5002, [float("nan")] * d, 1), (5003, [float("inf")] + [0.0] * (d - 1), 2), rows[7], (None, rows[9][1], 1)]
    return rows


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = np.stack([v for _, v, _ in kept])
    m = q.shape[1] // parts
    first = sorted((i, v.tolist()) for i, v, _ in kept if i is not None)[:entries]
    out, books = [], []
    for p in range(parts):
        x, book = q[:, p * m : (p + 1) * m], np.array([v[p * m : (p + 1) * m] for _, v in first])
        for turn in range(rounds + 1):
            d = ((x[:, None, :] - book[None]) ** 2).sum(2)
            code = d.argmin(1)
            if turn < rounds:
                book = np.stack([x[code == e].sum(0) // (code == e).sum() if (code == e).any() else book[e] for e in range(len(book))])
        out.append((code, d.min(1)))
        books.append(book)
    codes = ["".join(f"{out[p][0][k]:02x}" for p in range(parts)) for k in range(len(kept))]
    errors = sum(o[1] for o in out)
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + int(e)
    return [(i, c, int(e), by_label[label]) for (i, _, label), c, e in zip(kept, codes, errors)], hashlib.sha256(",".join(map(str, np.stack(books).ravel().tolist())).encode()).hexdigest()


@pytest.mark.parametrize("n, shard, hot", [(700, 4096, False), (700, 100, True), (60, 4096, False)])
def test_vector_codes(spark, monkeypatch, n, shard, hot):
    monkeypatch.setattr(vector_codes, "SHARD", shard)
    if hot:
        monkeypatch.setattr(vector_codes, "MAX_BROADCAST_LABELS", 0)
    rows = vectors(n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "error": F.lit("clash"), "q": F.lit(2), "n": F.lit(0)}).repartition(3)
    codes, books = vector_codes.compress(df)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_error(codes).collect()]
    want, digest = brute_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert vector_codes.digest(books) == digest


def test_vector_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    codes, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert codes.count() == 0 and books is None and vector_codes.digest(None) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="one length"):
        vector_codes.compress(spark.createDataFrame([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], schema).coalesce(1))
    same = spark.createDataFrame([(k, [0.5] * 4, None) for k in range(600)], schema)
    got = vector_codes.compress(same)[0].collect()
    assert len(got) == 600 and {(r["code"], r["error"]) for r in got} == {("00000000", 0)}


def test_metric_tree_gives_whole_balls():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-20, 20, (300, 3)) + c for c in ([0, 0, 0], [5000, 0, 0], [0, 9000, 0])])
    order, nodes = metric_tree.build(points)
    own = points[order]
    assert sorted(order) == list(range(900)) and nodes[0]["high"] == 900
    for node in nodes:
        part = own[node["low"] : node["high"]]
        assert (part.sum(0) == node["sum"]).all() and np.sqrt(((part - node["centre"]) ** 2).sum(1)).max() <= node["radius"] + 1e-6
    entries = np.array([[0, 0, 0], [5000, 0, 0], [0, 9000, 0], [0, 0, 0], [2500, 0, 0]])
    looked = []
    kept = metric_tree.squared
    try:
        metric_tree.squared = lambda a, b: looked.append(len(a)) or kept(a, b)
        codes, sums, counts = metric_tree.nearest(own, nodes, entries)
    finally:
        metric_tree.squared = kept
    d = ((own[:, None] - entries[None]) ** 2).sum(2)
    assert (codes == d.argmin(1)).all() and counts.tolist() == [300, 300, 300, 0, 0] and (sums[0] == own[codes == 0].sum(0)).all()
    # three far clusters: hardly any point is compared one by one
    assert sum(looked) - len(entries) < 100


# ---- hard negatives ----


def brute_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, label in kept:
        if not anchors(i):
            continue
        scored = sorted((-int(v @ w), j, own) for j, w, own in kept)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            inside = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(4096, 16_384), (64, 10)])
def test_hard_negatives(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    rows = vectors(600, seed=9)
    rows[30] = (rows[30][0], [0.0] * 16, 1)  # a zero vector scores 0 with all
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"anchor": F.lit("clash"), "q": F.lit(1), "score": F.lit(2)}).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block=block).collect()
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_hard_negatives_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    one_label = spark.createDataFrame([(k, [0.1 * k, 1.0], 1) for k in range(30)], schema)
    assert hard_negatives.mine(one_label, F.col("vec_id") % 10 == 0).count() == 0
    twice = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.7, 0.5], 2), (2, [0.7, 0.5], 2)]
    got = sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(twice, schema), F.col("vec_id") == 0).collect()))
    assert got == brute_negatives(twice, lambda i: i == 0) and len(got) == 4


def test_cover_tree_skips_nodes():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.integers(-5, 5, (400, 8)) + c for c in 300 * np.eye(8, dtype=np.int64)])
    order, nodes, norm = cover_tree.build(points)
    own = points[order]
    assert sorted(order) == list(range(len(points)))
    query, seen, best = np.array([[300, 0, 0, 0, 0, 0, 0, 0]]), [], [-(1 << 60)]

    def offer(rows, scores, active):
        seen.extend(rows.tolist())
        best[0] = max(best[0], int(scores.max()))

    cover_tree.descend(own, nodes, norm, query, lambda low, high, active: high >= best[0], offer)
    assert best[0] == (points @ query[0]).max() and len(seen) < 600


# ---- classes that have long texts only ----


def test_language_of_long_texts_only(spark):
    from marlstone.llm import language_id

    rng = random.Random(12)
    words = {"en": "the of and to in that is was for".split(), "de": "der die und das ist nicht ein".split(), "xx": "kala mitu vore sanna pilu tero".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, text(lang, 3000 if lang == "xx" else 30), lang) for k, lang in enumerate(["en", "de", "xx"] * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, index, _ = model = language_id.learn(docs, landmarks=16, train_rows=64)
    assert languages == ["de", "en", "xx"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert all(got[k] == lang for k, _, lang in rows)


def test_quality_of_long_texts_only(spark):
    from marlstone.llm import quality_classifier

    rng = random.Random(13)
    good, bad = "the river ran slowly past an old mill where we used to play as children".split(), "click here buy now cheap free win offer !!! $$$".split()
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(4500 if k % 2 else 60)), k % 2) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, quality_classifier.learn(docs, labels)).collect()}
    ranks = [(scored[a] > scored[b]) for a, _, p in rows for b, _, q in rows if p > q]
    assert sum(ranks) > 0.95 * len(ranks)


# ---- cells of several lines ----


def test_cells_keep_their_lines():
    from marlstone.llm.html_text import render

    page = "<table><tr><td><h1>Title</h1><p>First para.</p><ul><li>one<li>two</ul></td><td><pre>a\n  b</pre></td></tr></table>"
    assert render(page) == "Title       | a\n            |   b\nFirst para.\n\n- one\n- two"
    assert render("<table><tr><td>a<td>bb<tr><td>ccc<br>d<td>e</table>after") == "a   | bb\nccc | e\nd\n\nafter"
    assert render("<table><tr><td><p>P1</p><p>P2</p><table><tr><td>x<td>y</table></td></tr></table>") == "P1\n\nP2\n\nx | y"
    assert render("<table><tr><td> <td></table>") == ""


def test_layout_tables_against_a_plain_renderer():
    """A page and the same page inside a table of one cell read alike."""
    from marlstone.llm.html_text import render

    rng = random.Random(21)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"])
    for _ in range(50):
        parts, want = [], []
        for _ in range(rng.randint(1, 5)):
            kind, own = rng.choice(["p", "ul", "pre"]), [word() for _ in range(rng.randint(1, 3))]
            if kind == "p":
                parts.append(f"<p>{' '.join(own)}</p>")
                want.append(" ".join(own))
            elif kind == "ul":
                parts.append(f"<ul>{''.join(f'<li>{x}</li>' for x in own)}</ul>")
                want.append("\n".join(f"- {x}" for x in own))
            else:
                parts.append("<pre>" + "\n".join(own) + "</pre>")
                want.append("\n".join(own))
        body = "".join(parts)
        assert render(body) == render(f"<table><tr><td>{body}</td></tr></table>") == "\n\n".join(want)


# ---- fuzzy lines on a common template ----


@pytest.mark.parametrize("shared", [10, 13, 15])
def test_lines_on_a_template(spark, shared):
    """Lines that share most words, each with a copy in which three differ: of the pairs that are similar nearly all end in one group, of the others none by themselves."""
    from marlstone.llm import fuzzy_lines

    rng = random.Random(shared)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    frame, lines = [word() for _ in range(20)], []
    places = rng.sample(range(20), 20 - shared)
    for _ in range(100):
        own = list(frame)
        for k in places:
            own[k] = word()
        copy = list(own)
        for k in rng.sample(range(20), 3):
            copy[k] = word()
        lines += [" ".join(own), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    table = fuzzy_lines.line_table(docs)
    kept = {bytes(r["key"]): (r["kept_doc"], r["kept_line"]) for r in fuzzy_lines.line_groups(docs, table).collect()}
    group = [kept.get(fuzzy_lines.line_key(x.split(" ")), k) for k, x in enumerate(lines)]
    i, j = np.triu_indices(len(lines), 1)
    longest = np.maximum(*([len(lines[k]) for k in side] for side in (i, j)))
    similar = fuzzy_lines.edit_distances([lines[k] for k in i], [lines[k] for k in j]) <= 0.2 * longest + 1e-9
    together = np.array([group[a] == group[b] for a, b in zip(i, j)])
    assert similar.sum() >= 90 and together[similar].mean() >= 0.95
    # groups are the components of similar pairs, no more
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(i[similar], j[similar]):
        parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in zip(i[together], j[together]))


def test_each_string_counts_once():
    from marlstone.llm.minhash import distinct_hashes, gram_hashes

    texts = ["abababab", "a", "xyz xyz xyz", "aaaa"]
    h, lengths = gram_hashes(texts, 2)
    _, once = distinct_hashes(h, lengths)
    assert once.tolist() == [len({(t + "\0")[k : k + 2] for k in range(len(t))}) for t in texts]


@pytest.mark.parametrize("least, most", [(5, 15), (16, 40)])
def test_short_lines_with_one_edit_meet(least, most):
    from marlstone.llm import fuzzy_lines

    rng = np.random.default_rng(least)
    lines = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(least, most))) for _ in range(200)]
    copies = [x[: (at := int(rng.integers(len(x))))] + "0" + x[at + 1 :] for x in lines]
    met = 0
    for (kinds, blocks, *words), (kinds2, blocks2, *words2) in zip(fuzzy_lines.line_blocks(lines), fuzzy_lines.line_blocks(copies)):
        same = [
            (np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).any()
            and sum(((x[k] ^ y[k]) & ((1 << 64) - 1)).bit_count() for x, y in zip(words, words2)) <= fuzzy_lines.CLASSES[kind].radius
            for k, (kind, a, b) in enumerate(zip(kinds, blocks, blocks2))
        ]
        assert kinds == kinds2
        met += any(same)
    assert met >= 190


# ---- second comparison of lines ----


def test_few_pairs_are_compared_one_by_one(monkeypatch):
    """A handful of pairs does not pay for columns of many; the answers are the same, whichever way they come."""
    from marlstone.llm import fuzzy_lines

    rng = random.Random(4)
    left, right = [], []
    for n in (3, 63, 64, 65, 200, 700, 2500) * 4:
        line = [rng.choice("abcdefgh ") for _ in range(n)]
        copy = list(line)
        for at in rng.sample(range(n), round(n * rng.choice([0, 0.1, 0.19, 0.21, 0.3]))):
            copy[at] = rng.choice("xyz")
        left.append("".join(line)), right.append("".join(copy))
    want = [fuzzy_lines.edit_distance(a, b) <= 0.2 * len(a) + 1e-9 for a, b in zip(left, right)]
    assert 5 < sum(want) < len(want) - 5
    for a, b in zip(left, right):
        exact = fuzzy_lines.edit_distance(a, b)
        for most in (0, exact - 1, exact, 0.2 * len(a)):
            bounded = fuzzy_lines.edit_distance(a, b, most)
            assert bounded == exact if exact <= most else bounded > most
    many = fuzzy_lines.similar_pairs(left * 8, right * 8, 0.8)
    assert many.tolist() == want * 8
    monkeypatch.setattr(fuzzy_lines, "within", None)
    assert fuzzy_lines.similar_pairs(left, right, 0.8).tolist() == want


def test_open_pairs_are_found_without_texts(spark):
    from marlstone.llm import fuzzy_lines

    docs = spark.createDataFrame([(1, "one two three four five six\nquite another line of words\none two three four five sex")], "doc_id long, text string")
    classes = fuzzy_lines.line_classes(fuzzy_lines.line_table(docs))
    lines = {r["line"]: r["id"] for r in classes.collect()}
    groups = spark.createDataFrame([(lines[k], k) for k in lines], "id long, group long")
    got = fuzzy_lines.open_members(classes, groups)
    assert "line" not in got.columns and {r["id"] for r in got.collect()} == {lines[0], lines[2]}


def test_crowded_lines_meet_with_their_texts(spark):
    """Near lines of one block, more pairs than are told one by one, some similar: the open pairs come to what all pairs would."""
    from marlstone.llm import fuzzy_lines
    from marlstone.storage import materialize

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    frame, lines = [word() for _ in range(20)], []
    for _ in range(60):
        own = list(frame)
        for k in rng.sample(range(20), 4):
            own[k] = word()
        lines.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    classes = fuzzy_lines.line_classes(fuzzy_lines.line_table(docs))
    at = {r["doc"]: r["id"] for r in classes.collect()}
    # all lines are open: each has a link that failed
    links = materialize(spark.createDataFrame([(at[k], at[k + 1]) for k in range(0, 60, 2)], "a long, b long"), "test-links")
    verified = materialize(links.limit(0), "test-verified")
    pairs = {(r["a"], r["b"]) for r in fuzzy_lines.settled_links(docs, classes, links, verified, 0.8).collect()}
    i, j = np.triu_indices(60, 1)
    similar = fuzzy_lines.similar_pairs([lines[k] for k in i], [lines[k] for k in j], 0.8)
    of_id = {v: k for k, v in at.items()}
    true = {frozenset((int(a), int(b))) for a, b in zip(i[similar], j[similar])}
    assert 0 < len(true) and pairs and all(frozenset((of_id[a], of_id[b])) in true for a, b in pairs)

    def parts(edges):
        parent = list(range(60))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        return [root(x) for x in range(60)]

    got, want = parts((of_id[a], of_id[b]) for a, b in pairs), parts(tuple(x) for x in true)
    assert np.mean([got[a] == got[b] for a, b in true]) >= 0.95 and len(set(want)) < 60


def test_blocks_at_other_places_link_nothing(spark):
    """Two halves that change places keep their strings, but not their similarity: such lines are no candidates, similar ones still are."""
    from marlstone.llm import fuzzy_lines

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    halves = [" ".join(word() for _ in range(20)) for _ in range(2)]
    lines = [" ".join(halves), " ".join(halves[::-1]), " ".join([word(), *" ".join(halves).split(" ")[1:]])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    classes = fuzzy_lines.line_classes(fuzzy_lines.line_table(docs))
    at = {r["id"]: r["doc"] for r in classes.collect()}
    assert {frozenset((at[r["a"]], at[r["b"]])) for r in fuzzy_lines.candidate_links(classes).collect()} == {frozenset((0, 2))}


def test_places_lose_no_kept_string():
    from marlstone.llm import fuzzy_lines
    from marlstone.llm.minhash import placed_grams

    rng = random.Random(6)
    for n in (30, 90, 300) * 10:
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 20))
        cut, kept = rng.randrange(n - 20), "0123456789ABCDEFGHIJ"
        edited = ["".join(x + rng.choice(["", "", "", "", "xy"]) for x in part if rng.random() > 0.05) for part in (line[:cut], line[cut:])]
        one, two = line[:cut] + kept + line[cut:], kept.join(edited)
        if fuzzy_lines.similar_pairs([one], [two], 0.8)[0]:
            h, lengths, start = placed_grams([one, two], 10)
            a, b = np.flatnonzero(h[: lengths[0]] == h[lengths[0] + two.index(kept)])[0], two.index(kept)
            assert (start[a], start[lengths[0] + b]) == (one.index(kept), b)
            form = fuzzy_lines.forms([one, two])
            assert fuzzy_lines.may_align(form[:1], form[1:], np.array([a]), np.array([b]), 0.8)[0]


def test_stored_tables_pass_in_small_batches(spark):
    """Long texts go through Python a few MB at a time, and the session's own setting is as before."""
    import pyarrow as pa

    from marlstone.storage import materialize

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('long text ', 1000) AS text")
    held = materialize(texts.mapInArrow(sizes, "n long"), "test-sizes").selectExpr("max(n) AS most", "sum(n) AS all").first()
    assert held["most"] < 6e6 and held["all"] > 3e7 and spark.conf.get(key) == before
