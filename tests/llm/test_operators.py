"""The text operators against brute force, libraries and SQL, on small tables with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe_codec, decontamination, fuzzy_lines, html_text, language_id, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts
from marlstone.llm.components import connected_components
from marlstone.llm.linking import link_groups, near, nearest_forest
from marlstone.llm.run_length_index import RunLengthIndex

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and to in that is was for on with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "ing", "ed", ",", "."]) for _ in range(n))


def texts():
    """Plain, copied, nearly copied, repeated, empty, missing and odd texts."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 160)) + "\n" + prose(rng, rng.randint(5, 60)) for _ in range(40)]
    near_copies = []
    for t in base[:12]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near_copies.append(" ".join(w))
    odd = ["", " \n\t ", None, "word", "a" * 5000, "ab " * 400, "é" * 300 + " Ωmega ΟΔΟΣ", "x<|endoftext|>y  z", "\x1c\x1d a\x85b\xa0c᠎d", "don't we'LL 12 ½ 中文 字 🙂\r\n\r\n", "A | b | c | d\nA | b | c | d", "#$% *** && <|>", "𞤀𞤁 \U0001e5d0 \U00016d43"]
    return base + base[:6] + near_copies + odd + [prose(rng, 20_000)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Documents with a missing id, a repeated row and extra columns whose names clash with results."""
    rows = [(k, t, ["en", "de", None][k % 3], [None, "hot", "hot", "cold"][k % 4], None if t is None else len(t), 1, "x", True) for k, t in enumerate(texts())]
    rows += [rows[3], (None, "no id but a text", "en", "hot", 16, 1, "x", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, fingerprint string, kept boolean"
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# ---- language identification ----


def test_language_id(spark, tmp_path):
    rng = random.Random(3)
    other = "der die und das ist nicht ein eine mit auf für von sich auch werden haben schön über".split()
    rows = [(k, prose(rng, 30) if k % 2 else " ".join(rng.choice(other) for _ in range(30)), "en" if k % 2 else "de") for k in range(200)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !? 456", "de"), (None, "the of and", "en"), (903, "the and of " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = language_id.predict(docs, language_id.learn(docs, landmarks=16, train_rows=64)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(200))
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in out) and got[900]["score"] == 0
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.learn(empty) is None and language_id.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.keep_identified(docs, language_id.learn(docs, 16, 64)).columns == docs.columns


def test_language_id_learns_every_label(spark):
    rng = random.Random(8)
    own = {f"l{n:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for n in range(70)}
    rows = [(100 * n + k, " ".join(rng.choice(words) for _ in range(40)), lang) for n, (lang, words) in enumerate(own.items()) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.predict(docs, language_id.learn(docs)))
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)


def test_language_kernel_is_the_presence_kernel():
    a, b = "abcab", "bcabd"
    grams = lambda t: {t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)}
    for a, b in ((a, b), ("Ночь улица фонарь", "ночь аптека"), ("今日は良い天気です", "今日は雨です"), ("🙂🙂x", "x🙂🙂")):
        one, two = grams(a.lower()), grams(b.lower())
        assert language_id.Landmarks([b]).kernel([a])[0, 0] == pytest.approx(len(one & two) / (len(one) * len(two)) ** 0.5, abs=1e-6)


# ---- near-duplicates ----


def brute_simhash(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(table):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    fps = {i: brute_simhash(t) for i, t in rows if i is not None}
    want = components_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    out = simhash.near_duplicates(table).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == fps[r["doc_id"]] and len(r["fingerprint"]) == 16
            assert r["component_id"] == want[r["doc_id"]]


def test_simhash_without_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_similar_sets(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(31)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    texts = []
    for k in range(40):
        words = fresh(200)
        texts.append(words)
        for edits in rng.choices(range(1, 7), k=2):
            copy = list(words)
            for at in rng.sample(range(200), edits):
                copy[at] = "changed"
            texts.append(copy)
    texts += [fresh(3), fresh(3), []]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    want = components_of(range(len(texts)), [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(None, " ".join(texts[0])), (0, " ".join(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = simhash.similar_sets(docs).collect()
    assert len(out) == len(rows) and all(r["component_id"] == want[r["doc_id"] or 0] for r in out)
    assert 20 < len(set(want.values())) < len(texts) - 20
    kept = [r["doc_id"] for r in pipeline.dedup_documents(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(want.values()))  # of the repeated row, too, one stays, and none without an id
    assert simhash.similar_sets(spark.createDataFrame([], EMPTY)).count() == 0


def test_open_lines_meet_once(spark):
    blocks = np.array([[1, 2, 3], [1, 5, 3], [4, 5, 3]], np.uint32)
    at = lambda place, i, j: fuzzy_lines.first_shared(blocks, np.full(3, place), np.array([i]), np.array([j]))[0]
    assert at(0, 0, 1) and not at(2, 0, 1) and at(1, 1, 2) and not at(2, 1, 2) and at(2, 0, 2)
    docs = spark.createDataFrame([(1, "one two three four five six\nquite another line of words\none two three four five sex")], "doc_id long, text string")
    classes = fuzzy_lines.line_classes(fuzzy_lines.line_table(docs))
    lines = {r["line"]: r["id"] for r in classes.collect()}
    texts = lambda *groups: spark.createDataFrame([(lines[k], g, f"text {k}") for k, g in enumerate(groups)], "id long, group long, line string")
    wanted = {(r["key"], r["id"]): tuple(r) for r in fuzzy_lines._members(classes).collect() if r["id"] != lines[1]}
    of_key = {k: {i for key, i in wanted if key == k} for k, _ in wanted}
    got = fuzzy_lines.open_members(classes, texts(1, 2, 3)).collect()
    # texts travel with the blocks that two groups share, and with no other
    assert {(r["key"], r["id"]) for r in got} == {x for x in wanted if len(of_key[x[0]]) == 2} and 0 < len(got) < len(wanted)
    for r in got:
        assert tuple(r[c] for c in ("key", "id", "class", "form", *fuzzy_lines.PRINT)) == wanted[r["key"], r["id"]]
        assert np.frombuffer(r["blocks"], np.uint32)[r["place"]] == r["key"] & 0xFFFFFFFF and r["line"] == ("text 0" if r["id"] == lines[0] else "text 2")
    assert fuzzy_lines.open_members(classes, texts(1, 2, 1)).count() == 0


def test_distinct_ids_of_blocks(spark):
    rows = [("a", bucket, [1, 2, 3 + bucket]) for bucket in range(50)] + [("b", 0, [7]), ("b", 1, []), ("c", 0, [])]
    encoded = spark.createDataFrame(rows, "block string, bucket int, ids array<int>").repartition(3)
    got = {r["block"]: sorted(r["ids"]) for r in bpe_codec.distinct_ids(encoded).collect()}
    # a row an id and block: what is exploded does not grow with the buckets
    assert got == {"a": [1, 2, *range(3, 53)], "b": [7], "c": []}


def test_similar_sets_link_by_fingerprints(spark):
    rng = np.random.default_rng(5)
    far = 0
    for size, less in [(4, 1), (9, 1), (45, 5), (450, 50), (2700, 300)]:
        for _ in range(60):
            own = rng.integers(1, 1 << 63, size, dtype=np.uint64)
            # a set with one more, or one of equal size with a ninth replaced: a similarity of 0.8
            other = np.append(own, np.uint64(7)) if size == 4 else np.concatenate([own[less:], rng.integers(1, 1 << 63, less, dtype=np.uint64)])
            one, two = simhash.set_prints(np.concatenate([own, other]), np.array([len(own), len(other)]))
            far += np.bitwise_count(one ^ two).sum() > simhash.PRINT_RADIUS
    assert far <= 1
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words) + "  ")], "doc_id long, text string")
    roots = lambda **how: {r["doc_id"]: r["component_id"] for r in simhash.similar_sets(docs, **how).collect()}
    assert roots() == {1: 1, 2: 1, 3: 1}
    # the sets are as alike as before, but their fingerprints are not equal
    assert roots(radius=0) == {1: 1, 2: 2, 3: 1}


def test_simhash_links_of_random_fingerprints(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps):
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = list(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(f), k) for k, f in enumerate(fps)], "fp long, id long")
    want = components_of(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(classes)).collect()}
    assert all(got.get(k, k) == want[k] for k in want)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)] + [(5, 5)]
    want = components_of({x for e in edges for x in e}, edges)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != 5}


def test_nearest_forest():
    """The links join what all pairs within the radius join, each is such a pair, and their total length is the least."""
    rng = random.Random(6)
    fps = [rng.choice([0, 2**40 - 1, 2**63]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) for _ in range(150)]
    fps = np.array([f % 2**64 for f in fps], np.uint64)
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for a, b in ((fps, None), (fps[:70], fps[70:])):
        i, j = nearest_forest(a, b, 9)
        allowed = [(int(d), x, y) for (x, y), d in np.ndenumerate(far) if d <= 9 and x < y and (b is None or x < 70 <= y)]
        want, total, parent = components_of(range(150), [(x, y) for _, x, y in allowed]), 0, list(range(150))
        for d, x, y in sorted(allowed):
            root = lambda k: k if parent[k] == k else root(parent[k])
            if root(x) != root(y):
                parent[root(x)] = root(y)
                total += d
        assert components_of(range(150), list(zip(i.tolist(), j.tolist()))) == want
        assert far[i, j].max() <= 9 and far[i, j].sum() == total


@pytest.mark.parametrize("tile", [4, 2048])
def test_groups_of_any_size(spark, tile):
    """Tiles of a few rows give the same components as one tile."""
    rng = random.Random(5)
    fps = [rng.choice([0, 2**40]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(120)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    members = spark.createDataFrame([("k" if k % 3 else str(k % 9), k, signed(f % 2**64)) for k, f in enumerate(fps)], "key string, id long, fp long")
    linker = lambda one, two: near(*[None if t is None else t["fp"].to_numpy().view(np.uint64) for t in (one, two)], 3)
    key = {k: "k" if k % 3 else str(k % 9) for k in range(120)}
    want = components_of(range(120), [(a, b) for a in range(120) for b in range(a) if key[a] == key[b] and (fps[a] % 2**64 ^ fps[b] % 2**64).bit_count() <= 3])
    got = {r["node"]: r["root"] for r in connected_components(link_groups(members, linker, 3, tile_rows=tile)).collect()}
    assert all(got.get(k, k) == want[k] for k in want)


# ---- tokens ----


def test_token_counts(table):
    from tokenizers import Tokenizer

    source = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_str(source)
    out = token_counts.count_tokens(table, source, limit=50).collect()
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    assert len(out) == table.count()
    for r in out:
        t = text[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 50), t[:40]


def test_whole_tokens_are_single():
    source = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    whole = token_counts.whole_tokens(source)
    assert " the" in whole and "\n" in whole and " thethe" not in whole and len(whole) > 40_000


def test_bpe_codec(table, spark):
    from tokenizers import Tokenizer

    source = bpe_codec.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_str(source)
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = bpe_codec.transcode(table, source).collect()
    assert len(out) == table.count()
    for r in out:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    whole = bpe_codec.transcode(table.where("doc_id < 60").dropDuplicates(["doc_id"]), source, emit="texts")
    joined = {r["doc_id"]: r["decoded"] for r in bpe_codec.decode(whole, source).collect()}
    assert all(joined[r["doc_id"]] == r["decoded"] for r in whole.collect())
    assert bpe_codec.transcode(spark.createDataFrame([], EMPTY), source).count() == 0
    one = spark.createDataFrame([(1, "the same block")], "doc_id long, text string").coalesce(1)
    assert bpe_codec.transcode(one.union(one).union(one), source).count() == 3  # equal blocks share their words
    with pytest.raises(ValueError):
        bpe_codec.transcode(table, token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


# ---- quality ----


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 2000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality_rules(table, spark):
    out = quality_rules.judge(table).collect()
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    assert len(out) == table.count()
    for r in out:
        want = brute_rules(text[r["doc_id"]])
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got[:4] == want[:4] and want[4] in (None, got[4])
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.judge(spark.createDataFrame([], EMPTY)).count() == 0


def test_bad_hosts_go(spark, monkeypatch):
    rows = [(k, "too short" if k % 10 else prose(random.Random(k), 60), "bad") for k in range(100)] + [(100 + k, prose(random.Random(k), 60), f"good{k % 3}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (quality_rules.MAX_BROADCAST_HOSTS, 0):  # the salted join gives the same
        monkeypatch.setattr(quality_rules, "MAX_BROADCAST_HOSTS", most)
        out = by_id(quality_rules.judge(docs))
        assert not any(out[k]["kept"] for k in range(100)) and all(out[k]["kept"] for k in range(100, 200))


def test_host_verdicts_as_sql_has_them(spark, tmp_path):
    """Hosts of many sizes and rates, some of them rejected: the verdicts are those of the statement in SQL."""
    import duckdb

    rng, rows = random.Random(13), []
    for host in range(30):
        bad = rng.choice([0.0, 0.1, 0.4, 0.6, 0.9, 1.0])
        rows += [(len(rows) + k, "too short" if rng.random() < bad else prose(rng, 40), f"h{host}") for k in range(rng.choice([1, 2, 5, 60]))]
    rows += [(9000, None, "h1"), (9001, "", None), (9002, prose(rng, 30), None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.SQL})").fetchall()}
    out = by_id(quality_rules.judge(spark.read.parquet(path)))
    assert {i: r["kept"] for i, r in out.items()} == want
    rejected = {r["source" if "source" in r else "host"] for r in out.values() if not r["kept"] and not r["base_failed"]}
    alone = {r["host"]: r["host_rate"] for r in out.values()}
    assert 2 < len(rejected) < 25 and all(alone[h] > 0.5 for h in rejected)


def test_quality_classifier(spark):
    rng = random.Random(8)
    noise = lambda: " ".join(rng.choice(WORDS) + rng.choice(["###", "$$$", "%%%"]) for _ in range(60))
    rows = [(k, prose(rng, 60) if k % 2 else noise(), k % 2) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    out = by_id(quality_classifier.score(docs, quality_classifier.learn(docs, labels)))
    held = [(r["predicted"], k % 2) for k, r in out.items() if r["held_out"] and k < 400]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert out[900]["score"] == out[901]["score"] and all(0 <= r["score"] <= 1 for r in out.values())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.score(docs, quality_classifier.learn(docs, none)).collect()} == {0.5}
    one = labels.where("quality = 1")
    assert {r["score"] for r in quality_classifier.score(docs, quality_classifier.learn(docs, one)).collect()} == {1.0}


# ---- lines ----


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a):
            q = [i + 1]
            for j, d in enumerate(b):
                q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (c != d)))
            p = q
        return p[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(30))) for _ in range(2))
        assert fuzzy_lines.edit_distance(a, b) == plain(a, b)
    long = ["".join(rng.choice("abc d") for _ in range(rng.choice([1, 2, 63, 64, 65, 127, 128, 129, 200]))) for _ in range(60)]
    pairs = [(a, b) for a in long[:20] for b in long[20:60:3]] + [(a, a[: len(a) // 2] + "x" + a[len(a) // 2 + 1 :]) for a in long]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    want = [fuzzy_lines.edit_distance(a, b) for a, b in pairs]
    assert fuzzy_lines.edit_distances(left, right).tolist() == want
    longest = [max(len(a), len(b)) for a, b in pairs]
    assert fuzzy_lines.similar_pairs(left, right, 0.8).tolist() == [d <= n - 0.8 * n + 1e-9 for d, n in zip(want, longest)]
    assert fuzzy_lines.edit_distances(["日本" * 3000], ["日本" * 2999 + "x"]).tolist() == [2]


def brute_lines(rows):
    """Removed line numbers of each document, by the edit distances of all pairs of lines."""
    at = {}
    for i, t in sorted(rows):
        for n, line in enumerate((t or "").split("\n")):
            if w := line.lower().split():
                at.setdefault(" ".join(w), []).append((i, n))
    lines = sorted(at, key=len)
    links = []
    for a, x in enumerate(lines):
        for b in range(a + 1, len(lines)):
            longest = len(lines[b])
            if longest - len(x) > 0.2 * longest + 1e-9:
                break
            if fuzzy_lines.edit_distance(x, lines[b]) <= longest - 0.8 * longest + 1e-9:
                links.append((a, b))
    root = components_of(range(len(lines)), links)
    kept = {}
    for k, line in enumerate(lines):
        kept[root[k]] = min(kept.get(root[k], min(at[line])), min(at[line]))
    gone = {}
    for k, line in enumerate(lines):
        for o in at[line]:
            if o != kept[root[k]]:
                gone.setdefault(o[0], set()).add(o[1])
    return gone, len(links)


def test_fuzzy_lines(table):
    table = table.where("doc_id IS NOT NULL")
    rows = {(r["doc_id"], r["text"]) for r in table.collect()}
    gone, links = brute_lines(rows)
    assert links and gone
    out = fuzzy_lines.dedup_lines(table)
    assert out.columns == [*table.columns, "n_lines", "n_removed"]
    text = dict(rows)
    got = out.collect()
    assert len(got) == table.count()
    for r in got:
        t = text[r["doc_id"]]
        if t is None:
            assert r["text"] is None and r["n_lines"] == 0
        else:
            lines = t.split("\n")
            assert r["text"] == "\n".join(x for n, x in enumerate(lines) if n not in gone.get(r["doc_id"], ())) and r["n_lines"] == len(lines)


def test_fuzzy_lines_edges(spark):
    assert fuzzy_lines.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0
    docs = spark.createDataFrame([(1, "same line here\nsame line here\nx"), (None, "same line here"), (2, "Same  LINE here"), (2, "Same  LINE here\n \n\n")], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["text"]) for r in fuzzy_lines.dedup_lines(docs).collect())
    assert out == [(0, ""), (1, "same line here\nx"), (2, ""), (2, " \n\n")]


def test_fuzzy_lines_of_shared_ids(spark):
    """A line goes only for its own text, never for the number of a line of another row with the same id."""
    rows = [(None, "alpha beta unique"), (None, "a line seen before"), (1, "a line seen before"), (7, "gamma delta unique\nx y"), (7, "a line seen before\nz"), (9, "first of\ntwice here now"), (9, "twice here now\ntwice here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["text"]) for r in fuzzy_lines.dedup_lines(docs).collect())
    assert out == [(0, ""), (0, "alpha beta unique"), (1, "a line seen before"), (7, "gamma delta unique\nx y"), (7, "z"), (9, "first of"), (9, "twice here now")]
    rows = [(1, "alpha beta gamma delta"), (None, "alpha beta gamma delta\nsecond own line"), (None, "quite unrelated first line\nanother own text here")]
    out = sorted((r["doc_id"] or 0, r["text"]) for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(0, "quite unrelated first line\nanother own text here"), (0, "second own line"), (1, "alpha beta gamma delta")]


def test_forms_leave_no_similar_line_out():
    rng = random.Random(11)
    left, right = [], []
    for n in [*range(1, 60), 100, 300, 2000, 65_530, 70_000] * 8:
        line = [rng.choice("abcdefghij éü中") for _ in range(n)]
        edited = list(line)
        for _ in range(rng.randint(0, n // 5)):
            kind, at = rng.randrange(3), rng.randrange(len(edited))
            if kind == 0:
                edited[at] = rng.choice("xyzé")
            elif kind == 1 and len(edited) > 1:
                del edited[at]
            else:
                edited.insert(at, rng.choice("xyz"))
        left.append("".join(line)), right.append("".join(edited))
    # distances are at most the number of edits, so only short pairs need an exact one
    true = np.array([max(len(a), len(b)) > 400 or 1 - fuzzy_lines.edit_distance(a, b) / max(len(a), len(b)) >= 0.8 for a, b in zip(left, right)])
    true &= np.array([len(b) >= len(a) or len(a) <= 400 for a, b in zip(left, right)])
    passed = fuzzy_lines.may_be_similar(fuzzy_lines.forms(left), fuzzy_lines.forms(right), 0.8)
    assert true.sum() > 300 and passed[true].all()
    apart = fuzzy_lines.may_be_similar(fuzzy_lines.forms(["abcdefgh"]), fuzzy_lines.forms(["zzzzzzzz"]), 0.8)
    assert not apart.any()


@pytest.mark.parametrize("least, most", [(1, 1), (2, 5), (6, 10), (11, 20), (21, 40), (41, 100)])
def test_recall_of_similar_lines(spark, least, most):
    """Of pairs of lines with an edit similarity of 0.8 or more, made by replaced words or letters, nine in ten are found, and no other line goes."""
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    rows, pairs = [], 0
    while pairs < 120:
        words = [word() for _ in range(rng.randint(least, most))] if most > 1 else ["".join(word() for _ in range(rng.randint(2, 8)))]
        line, copy = " ".join(words), list(words)
        if rng.random() < 0.5 and most > 1:
            for at in rng.sample(range(len(words)), max(1, round(rng.random() * 0.15 * len(words)))):
                copy[at] = word()
            copy = " ".join(copy)
        else:
            copy = list(line)
            for at in rng.sample(range(len(line)), max(1, round(rng.random() * 0.08 * len(line)))):
                copy[at] = rng.choice("0123456789")
            copy = "".join(copy)
        longest = max(len(line), len(copy))
        if fuzzy_lines.edit_distance(line, copy) <= 0.2 * longest:
            rows += [(2 * pairs, line), (2 * pairs + 1, copy)]
            pairs += 1
    gone, links = brute_lines(rows)
    out = {r["doc_id"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    assert len(gone) >= 115 and out <= set(gone) and len(out) >= 0.9 * len(gone)


def test_lines_without_spaces(spark):
    rows = [(1, "日本語の一行です、二度あります"), (2, "日本語の一行です、二度あります"), (3, "日本語の一行です、三度あります"), (4, "ab"), (5, "ab"), (6, "b"), (7, "------------------"), (8, "-----------------"), (9, "===")]
    out = {r["doc_id"]: r["n_removed"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0, 8: 1, 9: 0}


# ---- long repeats ----


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = (t or "").encode()
        mark = np.zeros(len(x) + 1, int)
        for a in range(len(x) - length + 1):
            if x[a : a + length] in seen:
                mark[a] += 1
                mark[a + length] -= 1
            seen.add(x[a : a + length])
        m = np.cumsum(mark[:-1]) > 0
        a = np.frombuffer(x, np.uint8)
        out[i] = (len(x), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(a[~m].tobytes()).hexdigest())
    return out


def test_run_length_index():
    rng = random.Random(3)
    for _ in range(25):
        base, parts = bytes(rng.choice(b"abc") for _ in range(60)), []
        for _ in range(rng.randint(1, 20)):
            x = bytearray(base * rng.randint(0, 3))
            for _ in range(rng.randint(0, 4)):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(b"abcd\0")
            parts.append(bytes(x))
        index = RunLengthIndex(parts)
        got, seen = index.repeats(12), set()
        assert index.runs <= index.size
        for k, x in enumerate(parts):
            for i in range(len(x)):
                w = x[i : i + 12]
                assert bool(got[index.starts[k] + i]) == (len(w) == 12 and w in seen)
                seen.add(w)


def test_suffix_dedup(table, spark, tmp_path):
    rows = {(r["doc_id"], r["text"]) for r in table.where("doc_id IS NOT NULL").collect()}
    want = brute_repeats([(i, t) for i, t in rows if t is None or len(t) < 50_000] + [(i, t) for i, t in rows if t is not None and len(t) >= 50_000])
    spark.range(1).count()
    table.write.parquet(str(tmp_path / "documents.parquet"))
    out = suffix_dedup.query(spark, str(tmp_path)).collect()
    assert len(out) == table.count()
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert sum(r["n_removed"] for r in out) > 1000
    assert suffix_dedup.find_repeats(spark.createDataFrame([], EMPTY)).count() == 0


def test_suffix_dedup_of_shared_ids(spark):
    """Different texts under one id lose only what repeats in themselves."""
    rng = random.Random(23)
    a, b, c = prose(rng, 60), prose(rng, 70), prose(rng, 50)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c + b), (None, a)]
    out = suffix_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r["doc_id"] or 0, r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"])) for r in out)
    assert removed == sorted([(0, len(a), 0), (1, len(a), 0), (2, len(a), len(a)), (2, len(b), 0), (2, len(b), 0), (3, len(c + b), len(b))])


@pytest.mark.parametrize("step, crowd", [(512, 256), (1 << 18, 1), (512, 2)])
def test_suffix_dedup_of_long_texts_and_crowds(spark, step, crowd):
    """Long texts are scanned in pieces; an anchor with many different contexts is settled window by window."""
    rng = random.Random(12)
    long, fixed = prose(rng, 900), "a fixed piece of exactly one anchor length or a little more than that, so it says"
    rows = [(0, long), (1, long[700:3000]), (2, "x" * 3000), (3, long + "!" + long)]
    rows += [(10 + k, prose(rng, 6) + fixed + prose(rng, 6)) for k in range(40)] + [(60 + k, "start " + fixed + " of a text like others " + str(k % 4)) for k in range(12)]
    out = suffix_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), step=step, crowd=crowd).collect()
    want = brute_repeats(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


# ---- decontamination ----


def brute_hits(docs, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for name, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(None if name is None else str(name))
    out = {}
    for d, t in docs:
        w, hit, names = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[g]
        out[d] = (len(w), len(hit), [*sorted(names - {None}), *(names & {None})])
    return out


def test_decontamination(table, spark):
    table = table.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    text = dict(rows)
    items = [(1, text[0][:150]), (2, text[1]), (10, "WORD"), (3, ""), (4, None), (5, "ab ab ab"), (6, "é" * 300 + " Ωmega"), (1, text[5][20:200]), (None, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = brute_hits(rows, items)
    for block in (1 << 20, 2000, 1):  # in one block, in several, and in as many as there are items
        got = by_id(decontamination.find_overlaps(table, bench, block_bytes=block))
        assert {d: (r["n_words"], len(r["hits"]), r["items"]) for d, r in got.items()} == want
    assert sum(bool(v[1]) for v in want.values()) > 3
    none = decontamination.find_overlaps(table, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["hits"] for r in none)
    assert decontamination.find_overlaps(spark.createDataFrame([], EMPTY), bench).count() == 0


def test_decontamination_of_shared_ids(spark):
    """Rows that share an id stand each for itself, in any number of blocks."""
    rows = [(7, "one two three"), (7, "nothing of it"), (None, "two"), (None, "four five"), (8, None), (8, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "two"), (None, "five")], "item_id long, text string")
    for block in (1, 8, 1 << 20):
        out = sorted((r["doc_id"] or 0, r["n_words"], len(r["hits"]), [x or "" for x in r["items"]]) for r in decontamination.find_overlaps(docs, bench, block_bytes=block).collect())
        assert out == [(0, 1, 1, ["3"]), (0, 2, 2, ["2", ""]), (7, 3, 0, []), (7, 3, 3, ["1", "3"]), (8, 0, 0, []), (8, 3, 3, ["1", "3"])]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta gamma"), (3, "gamma beta alpha far away")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = lambda slop: {r["doc_id"] for r in decontamination.find_overlaps(docs, bench, slop=slop).collect() if r["hits"]}
    assert found(0) == {2} and found(2) == {1, 2}
    apart = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "gamma"), (4, "x " * 70 + "beta")], "doc_id long, text string").coalesce(1)
    assert not any(r["hits"] for r in decontamination.find_overlaps(apart, bench, slop=80).collect())  # never across documents


# ---- pages ----


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain <b>bold</b>\n text", "plain bold text"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol><li>z</ul>", "- x\n- y\n  3. p\n  4. q\n- z"),
        ("<table><tr><th>a<th>bbb<tr><td>ccccc<td>d<p>e</table>", "a     | bbb\nccccc | d e"),
        ("<head><title>t</title></head><script>if (a < b) '</p>'</script><style>p{}</style>seen<!-- not <b>this</b> -->", "seen"),
        ("<p hidden>no</p><p style='display : none'>no</p><div style='visibility:hidden'>no<p>no</div>yes", "yes"),
        ("<details><summary>S</summary>closed</details><details open><summary>T</summary>open</details>", "S\nT\nopen"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("&lt;tag&gt; &amp;copy; caf&eacute; &#8364;", "<tag> &copy; café €"),
        ("a<b", "a"),
        ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
        ("<a title='x > y'>link</a> <img alt=no><input type=hidden value=no><input type=submit value=Go>", "link Go"),
        ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", "A | b1\n  | b2"),
        ("<table><tr><td>a<td rowspan=0>B<td>c<tr><td>d<td>e<tr><td colspan=2>f<td>g</table>", "a | B | c\nd |   | e\nf |   | g"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>p<td>q<td>r<tr><td rowspan=x>s</table>", "wide |   | x\np    | q | r\ns"),
        ("<table><tr><td rowspan=3>A<td>b<tr><tr><td>c</table>", "A | b\n  | c"),
        ("<table><tr><td>outer<table><tr><td>inner</table><td>next</table>", "outer inner | next"),
    ],
)
def test_rendering(page, want):
    assert html_text.render(page) == want


def test_pages(spark):
    deep = "<div>" * 50_000 + "x"
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "b"), (4, deep), (5, "<" * 20_000)], "page_id long, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"] if r["page_id"] != 5 else "", r["n_lines"] if r["page_id"] != 5 else 0) for r in out) == [(0, "b", 1), (1, None, 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (4, "x", 1), (5, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- pipeline ----


def test_pipeline_edges(spark, tmp_path):
    """Missing ids, repeated rows, texts that share an id, clashing and further columns, and an empty table."""
    import corpus_pipeline as pipeline

    rng = random.Random(22)
    a, b, passage = (prose(rng, 60) for _ in range(3))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, hits string, key string"
    rows = [(5, a), (5, a), (None, a), (5, b), (None, b + " " + passage), (6, b + " " + passage), (7, passage), (8, None), (9, ""), (None, prose(rng, 50)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "h", "k") for i, t in rows], schema).repartition(2)
    ids = lambda df: sorted((r["doc_id"] or 0, (r["text"] or "")[:20]) for r in df.collect())
    out = pipeline.dedup_documents(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    # one of the three copies of a; b and its longer form are far apart; the texts without words are one
    assert ids(out) == sorted([(5, a[:20]), (5, b[:20]), (6, b[:20]), (7, passage[:20]), (8, ""), (0, rows[9][1][:20])])
    out = pipeline.decontaminate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert ids(out) == sorted([(5, a[:20]), (5, a[:20]), (0, a[:20]), (5, b[:20]), (8, ""), (9, ""), (0, rows[9][1][:20]), (0, "")])
    lines = pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and lines.count() == len(rows)
    assert pipeline.identify_language(spark, docs, str(tmp_path)).columns == docs.columns
    assert pipeline.encode(spark, docs, str(tmp_path)).count() == len(rows)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    passage = prose(rng, 40)
    rows = [(k, "\n".join(prose(rng, 40) for _ in range(3)), "en", "s", 0) for k in range(30)]
    rows += [(30, rows[0][1], "en", "s", 0), (31, None, None, None, None), (32, "12345", "en", "s", 5), (33, prose(rng, 30) + "\n" + passage, "en", "s", 0)]
    spark.createDataFrame(rows, EMPTY).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"] for r in docs.collect()}
    assert seen["language_id"] == set(range(31)) | {33}
    assert seen["line_dedup"] == seen["language_id"]
    assert 33 not in seen["decontamination"] and seen["decontamination"] >= set(range(30))
    whole = {r["doc_id"]: r["ids_sha256"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r["doc_id"]: r["ids_sha256"] for r in docs.collect()}
