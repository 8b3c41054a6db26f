"""Signal expressions over feature columns: + - * /, abs and neg.

Text is read by Python's own ``ast`` module and held against a short list of
what is allowed; the tree becomes a Column. Division by zero gives NULL.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.storage import materialize

FUNCTIONS = ("abs", "neg")
_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
#: What an operator costs, and the limits of an expression.
COSTS = {"/": 2}
MAX_SIZE, MAX_DEPTH, PARSIMONY = 18, 5, 0.012


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    op: str  # "number", "name", an operator or a function
    value: object = None
    args: tuple[Node, ...] = ()


def parse(text: str) -> Node:
    if not text or not text.strip():
        raise ExpressionError("empty expression")
    try:
        return _allowed(ast.parse(text.strip(), mode="eval").body)
    except (SyntaxError, RecursionError) as e:
        raise ExpressionError(f"no expression: {text!r}") from e


def _allowed(node: ast.AST) -> Node:
    match node:
        case ast.Constant(value=int() | float() as value) if not isinstance(value, bool):
            return Node("number", float(value))
        case ast.Name(id=name):
            return Node("name", name)
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return Node("neg", args=(_allowed(inner),))
        case ast.Call(func=ast.Name(id=name), args=[inner], keywords=[]) if name in FUNCTIONS:
            return Node(name, args=(_allowed(inner),))
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _OPERATORS:
            out = Node(_OPERATORS[type(op)], args=(_allowed(left), _allowed(right)))
            if out.op == "/" and out.args[1].op == "number" and out.args[1].value == 0:
                raise ExpressionError("division by zero")
            return out
    raise ExpressionError(f"not allowed: {ast.unparse(node)}")


def walk(tree: Node):
    yield tree
    for a in tree.args:
        yield from walk(a)


def is_valid(text: str) -> bool:
    try:
        parse(text)
    except ExpressionError:
        return False
    return True


def used_features(tree: Node) -> list[str]:
    return sorted({n.value for n in walk(tree) if n.op == "name"})


def operator_counts(tree: Node) -> dict[str, int]:
    out: dict[str, int] = {}
    for n in walk(tree):
        if n.args:
            out[n.op] = out.get(n.op, 0) + 1
    return out


def complexity(tree: Node) -> int:
    return sum(COSTS.get(n.op, 1) for n in walk(tree))


def depth(tree: Node) -> int:
    return 1 + max(map(depth, tree.args), default=0)


def within_limits(tree: Node) -> bool:
    return complexity(tree) <= MAX_SIZE and depth(tree) <= MAX_DEPTH


def to_column(tree: Node, features: list[str] | None = None) -> Column:
    """The tree as a Column; with ``features`` given, other names raise."""
    if tree.op == "number":
        return F.lit(tree.value)
    if tree.op == "name":
        if features is not None and tree.value not in features:
            raise ExpressionError(f"unknown feature: {tree.value}")
        return F.col(f"`{tree.value}`")
    args = [to_column(a, features) for a in tree.args]
    if tree.op == "neg":
        return -args[0]
    if tree.op == "abs":
        return F.abs(args[0])
    if tree.op == "/":
        return F.try_divide(*args)
    return {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[tree.op](*args)


def predict(features: DataFrame, expression: str, name: str = "alpha") -> DataFrame:
    return features.withColumn(name, to_column(parse(expression), features.columns))


def candidate_table(spark: SparkSession, expressions: list[str]) -> DataFrame:
    """(candidate_id, expression, is_valid, within_limits, complexity, depth, features, n_features, n_operators)."""
    rows = []
    for k, text in enumerate(expressions):
        if is_valid(text):
            t = parse(text)
            rows.append((k, text, True, within_limits(t), complexity(t), depth(t), used_features(t), len(used_features(t)), sum(operator_counts(t).values())))
        else:
            rows.append((k, text, False, False, None, None, None, None, None))
    return spark.createDataFrame(rows, "candidate_id int, expression string, is_valid boolean, within_limits boolean, complexity int, depth int, features array<string>, n_features int, n_operators int")


#: Most candidates that are compared pair by pair: a short list, such as ``metrics.best`` gives.
MAX_COMPARED = 100


def compare(candidates: DataFrame) -> DataFrame:
    """Pairs of candidates: same text, same features, differences of complexity (and loss, if there is one); more than MAX_COMPARED raise."""
    if candidates.limit(MAX_COMPARED + 1).count() > MAX_COMPARED:
        raise ValueError(f"more than {MAX_COMPARED} candidates to compare")
    left, right = candidates.alias("l"), candidates.alias("r")
    out = [
        F.col("l.candidate_id").alias("left_id"), F.col("r.candidate_id").alias("right_id"), (F.col("l.expression") == F.col("r.expression")).alias("same_text"),
        (F.col("l.features") == F.col("r.features")).alias("same_features"), (F.col("l.complexity") - F.col("r.complexity")).alias("complexity_diff"),
    ]
    if "loss" in candidates.columns:
        out.append((F.col("l.loss") - F.col("r.loss")).alias("loss_diff"))
    return left.join(right, F.col("l.candidate_id") < F.col("r.candidate_id")).select(*out)


def enumerate_expressions(
    features: list[str], operators: tuple[str, ...] = ("+", "-", "*", "/"), unary: tuple[str, ...] = ("neg", "abs"), levels: int = 1, limit: int = 10_000
) -> list[str]:
    """The grammar in order of nesting, within MAX_SIZE and MAX_DEPTH.

    Level 0 holds the features; each further level applies every operator to
    what the levels before it hold (once for those that commute). More than
    ``limit`` expressions raise, none is left out.
    """
    held: list[tuple[str, int]] = [(f, 0) for f in features]  # text and level
    for level in range(1, levels + 1):
        part = lambda x: x if x.isidentifier() else f"({x})"
        new = [f"{u}({a})" for u in unary for a, at in held if at == level - 1]
        for op in operators:
            for i, (a, at) in enumerate(held):
                for j, (b, bt) in enumerate(held):
                    if max(at, bt) == level - 1 and (i != j and (op in "-/" or i < j) or i == j and op == "*"):
                        new.append(f"{part(a)} {op} {part(b)}")
        held += [(x, level) for x in new if within_limits(parse(x))]
        if len(held) > limit:
            raise ValueError(f"more than {limit} expressions; take fewer features or levels")
    return [x for x, _ in held]


_GRAMMAR = "expression string, canonical string, level int, complexity int, depth int, operator string, left string, right string, sample array<double>"


def _significant(x: Column, digits: int = 9) -> Column:
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - digits)
    return F.when(x == 0, 0.0).otherwise(F.round(x / size) * size)


def _applied(op: Column, a: Column, b: Column) -> Column:
    """A row's value of ``a op b``; NULL where it has none."""
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b)).when(op == "neg", -a).otherwise(F.abs(a))


def _inner(text: Column) -> Column:
    return F.when(text.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), text).otherwise(F.concat(F.lit("("), text, F.lit(")")))


def sample_of(frame: DataFrame, names: list[str], rows: int = 64) -> dict[str, list[float]]:
    """Values of features on ``rows`` complete rows, chosen by a hash: what two expressions must differ on to count as two."""
    picked = frame.dropna(subset=names).select(*[F.col(c).cast("double").alias(c) for c in names]).orderBy(F.xxhash64(*names)).limit(rows).collect()
    return {c: [r[c] for r in picked] for c in names}


def grammar(spark: SparkSession, features: list[str], operators: tuple[str, ...] = ("+", "-", "*", "/"), unary: tuple[str, ...] = ("neg", "abs"), levels: int = 2, sample: dict[str, list[float]] | None = None, limit: int = 1_000_000) -> DataFrame:
    """The grammar as a table, level by level, each expression once: (expression, canonical, level, complexity, depth, operator, left, right, sample).

    Level 0 holds the features; a further level applies every operator to what the levels before it hold.
    What is equal by the form (``x + y`` and ``y + x``, ``neg(x - y)`` and ``y - x``, ``abs(neg(x))`` and ``abs(x)``,
    ``neg(neg(x))`` and ``x``, ``abs(x - y)`` and ``abs(y - x)``) has one canonical text, and the cheapest of it stays. With a
    ``sample`` of the features' values, what is equal there to nine digits counts as equal too. Expressions beyond
    MAX_SIZE and MAX_DEPTH are left out; more than ``limit`` raise. A level is met with all before it, held to ``limit`` rows.
    """
    first = [(f, f, 0, 1, 1, None, None, None, None if sample is None else [float(v) for v in sample[f]]) for f in features]
    held = materialize(spark.createDataFrame(first, _GRAMMAR), "grammar")
    for level in range(1, levels + 1):
        a, b = held.alias("a"), F.broadcast(held.select("expression", "canonical", "level", "complexity", "depth", "sample")).alias("b")
        ones = held.where(F.col("level") == level - 1).select(F.explode(F.array(*[F.lit(u) for u in unary])).alias("op"), *[F.col(c).alias(f"a_{c}") for c in ("expression", "canonical", "complexity", "depth", "sample")])
        canon = F.col("a_canonical")
        plain = F.when((F.col("op") == "neg") & canon.startswith("neg("), F.expr("substring(a_canonical, 5, length(a_canonical) - 5)"))
        plain = plain.when((F.col("op") == "neg") & canon.startswith("-["), F.concat(F.lit("-["), F.element_at(_sides(canon), 2), F.lit("|"), F.element_at(_sides(canon), 1), F.lit("]")))
        plain = plain.when((F.col("op") == "abs") & canon.startswith("abs("), canon).when((F.col("op") == "abs") & canon.startswith("neg("), F.concat(F.lit("abs("), F.expr("substring(a_canonical, 5, length(a_canonical) - 5)"), F.lit(")")))
        plain = plain.when((F.col("op") == "abs") & canon.startswith("-["), F.concat(F.lit("abs(-["), F.array_join(F.array_sort(_sides(canon)), "|"), F.lit("])")))
        plain = plain.otherwise(F.concat("op", F.lit("("), canon, F.lit(")")))
        none = F.lit(None)
        new_one = ones.select(
            F.concat("op", F.lit("("), "a_expression", F.lit(")")).alias("expression"), plain.alias("canonical"), F.lit(level).alias("level"), (F.col("a_complexity") + 1).alias("complexity"), (F.col("a_depth") + 1).alias("depth"),
            F.col("op").alias("operator"), F.col("a_expression").alias("left"), none.cast("string").alias("right"), F.transform("a_sample", lambda x: _significant(_applied(F.col("op"), x, x))).alias("sample"),
        )
        met = a.join(b, F.greatest("a.level", "b.level") == level - 1).select(
            F.explode(F.array(*[F.lit(o) for o in operators])).alias("op"), *[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in ("a", "b") for c in ("expression", "canonical", "complexity", "depth", "sample")]
        )
        order = F.col("a_canonical") < F.col("b_canonical")
        equal = F.col("a_canonical") == F.col("b_canonical")
        met = met.where(F.when(F.col("op") == "+", order).when(F.col("op") == "*", order | equal).otherwise(~equal))
        new_two = met.select(
            F.concat(_inner(F.col("a_expression")), F.lit(" "), "op", F.lit(" "), _inner(F.col("b_expression"))).alias("expression"), F.concat("op", F.lit("["), "a_canonical", F.lit("|"), "b_canonical", F.lit("]")).alias("canonical"),
            F.lit(level).alias("level"), (F.col("a_complexity") + F.col("b_complexity") + F.when(F.col("op") == "/", COSTS["/"]).otherwise(1)).alias("complexity"), (F.greatest("a_depth", "b_depth") + 1).alias("depth"),
            F.col("op").alias("operator"), F.col("a_expression").alias("left"), F.col("b_expression").alias("right"), F.zip_with("a_sample", "b_sample", lambda x, y: _significant(_applied(F.col("op"), x, y))).alias("sample"),
        )
        fresh = new_one.unionByName(new_two).where((F.col("complexity") <= MAX_SIZE) & (F.col("depth") <= MAX_DEPTH))
        fresh = _cheapest(fresh, F.col("canonical")).join(held.select("canonical"), "canonical", "left_anti")
        if sample is not None:
            fresh = _cheapest(fresh, _print()).join(held.select(_print().alias("print")), _print() == F.col("print"), "left_anti")
        held = materialize(held.unionByName(fresh.select(*held.columns)), "grammar")
        if held.count() > limit:
            raise ValueError(f"more than {limit} expressions; take fewer features or levels")
    return held


def _sides(canonical: Column) -> Column:
    """The two operands of a canonical difference, found where no bracket is open: the text before and after its own bar."""
    text = F.expr("substring(a_canonical, 3, length(a_canonical) - 3)")
    letters = F.split(text, "")
    open_at = F.aggregate(letters, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("bar")), lambda s, x: F.struct(
        (s["depth"] + F.when(x.isin("[", "("), 1).when(x.isin("]", ")"), -1).otherwise(0)).alias("depth"), (s["at"] + 1).alias("at"),
        F.when((s["bar"] == 0) & (s["depth"] == 0) & (x == "|"), s["at"] + 1).otherwise(s["bar"]).alias("bar"),
    ))
    bar = open_at["bar"]
    return F.array(text.substr(F.lit(1), bar - 1), text.substr(bar + 1, F.length(text)))


def _print() -> Column:
    return F.sha1(F.to_json(F.struct("sample")))


def _cheapest(fresh: DataFrame, key: Column) -> DataFrame:
    rows = F.struct(*[F.col(c) for c in fresh.columns])
    return fresh.groupBy(key.alias("_key")).agg(F.min_by(rows, F.struct("complexity", "expression")).alias("row")).select("row.*")
