"""Mixing sources to target weights by hierarchical budgeting.

Weights are given on a tree of domain, language and source. A budget of
tokens runs down the tree: children share their parent's budget by weight,
and none gets more than its whole subtree can supply in ``max_epochs``
passes; what one cannot use goes to its siblings first, and leaves the
subtree only where all of them are full. Each leaf then takes whole epochs
and, of the next epoch's seeded order, the longest prefix of documents that
fits. The prefix is found from sums over hash ranges, so that only the one
range that holds its end is ever put in order, and that by stretches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import running, stored

#: The hash range that holds a prefix's end is found in so many steps, each of
#: so many bits of the hash.
STEPS, BITS = 3, 6


@dataclass(frozen=True)
class Plan:
    """``weights``: (domain, lang, source) paths to the weight at each level,
    as {domain: (weight, {lang: (weight, {source: weight})})}; ``domain`` is
    an SQL expression over source and lang. A document whose path is not in
    the tree has no weight and is not taken."""

    weights: dict
    domain: str
    share: Fraction = Fraction(9, 10)
    max_epochs: int = 2
    seed: int = 17
    levels: tuple = field(default=("domain", "lang", "source"))


def split(budget: int, weights: list[Fraction], most: list[int]) -> list[int]:
    """Whole tokens for each child in proportion to the weights, none over
    its ``most``; a child's surplus goes to the others in proportion again.
    Fractions of tokens go to the largest remainders, the first on ties."""
    out, live = [0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    budget = min(budget, sum(most[i] for i in live))
    while live:
        total = sum(weights[i] for i in live)
        full = [i for i in live if budget * weights[i] / total >= most[i]]
        if not full:
            exact = {i: budget * weights[i] / total for i in live}
            for i in live:
                out[i] = int(exact[i])
            rest = budget - sum(out[i] for i in live)
            for i in sorted(live, key=lambda i: (out[i] - exact[i], i))[:rest]:
                out[i] += 1
            break
        for i in full:
            out[i] = most[i]
            budget -= most[i]
        live = [i for i in live if i not in full]
    return out


def allocate(tree: dict, supply: dict[tuple, int], budget: int, path: tuple = ()) -> dict[tuple, int]:
    """Tokens of each leaf path. ``supply`` is what each leaf can give."""

    def capacity(node, at: tuple) -> int:
        if isinstance(node, dict):
            return sum(capacity(x[1] if isinstance(x, tuple) else None, (*at, k)) for k, x in node.items() if (x[0] if isinstance(x, tuple) else x) > 0)
        return supply.get(at, 0)

    keys = list(tree)
    weights = [Fraction(str(tree[k][0] if isinstance(tree[k], tuple) else tree[k])) for k in keys]
    most = [capacity(tree[k][1] if isinstance(tree[k], tuple) else None, (*path, k)) for k in keys]
    out = {}
    for k, tokens in zip(keys, split(budget, weights, most), strict=True):
        if isinstance(tree[k], tuple):
            out |= allocate(tree[k][1], supply, tokens, (*path, k))
        else:
            out[(*path, k)] = tokens
    return out


def measured(docs: DataFrame, plan: Plan) -> DataFrame:
    """Adds _leaf (null outside the tree), _tokens (words) and _text_code."""
    leaves = {p for p in _leaves(plan.weights)}
    known = F.concat_ws("\x1f", *[F.coalesce(F.col(f"_{x}"), F.lit("")) for x in plan.levels])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.withColumn("_domain", F.expr(plan.domain).cast("string"))
        .withColumn("_lang", F.col("lang").cast("string"))
        .withColumn("_source", F.col("source").cast("string"))
        .withColumn("_tokens", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
        .withColumn("_text_code", F.xxhash64(text))
        .withColumn("_leaf", F.when(known.isin(["\x1f".join(p) for p in sorted(leaves)]), known))
    )


def _leaves(tree: dict, path: tuple = ()):
    for k, x in tree.items():
        if isinstance(x, tuple):
            yield from _leaves(x[1], (*path, k))
        else:
            yield (*path, k)


def _order(plan: Plan, epoch: Column) -> Column:
    return F.xxhash64(F.lit(plan.seed), epoch, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("_text_code"))


def budgets(slim: DataFrame, plan: Plan) -> list[tuple]:
    """Per leaf of the tree: (leaf, target, epochs, range, before): whole
    epochs, the hash range that holds the prefix's end and the tokens before
    it. One row per leaf comes to the driver, as many as the tree has."""
    spark = slim.sparkSession
    have = {r["_leaf"]: r["n"] for r in slim.where("_leaf is not null").groupBy("_leaf").agg(F.sum("_tokens").alias("n")).collect()}
    total = slim.agg(F.sum("_tokens")).first()[0] or 0
    supply = {tuple(k.split("\x1f")): n * plan.max_epochs for k, n in have.items()}
    target = {"\x1f".join(p): n for p, n in allocate(plan.weights, supply, int(total * plan.share)).items()}
    rows = [(k, n, n // have[k] if have.get(k) else 0) for k, n in sorted(target.items())]
    if not rows:
        return []
    # the end's range: its first bits, the tokens before it, and whether it exists at all
    ends = {k: (0, 0) for k, _, e in rows if have.get(k)}
    rest = {k: n - e * have.get(k, 0) for k, n, e in rows}
    for step in range(STEPS):
        goals = spark.createDataFrame([(k, e, ends[k][0]) for k, _, e in rows if k in ends], "_leaf string, _epochs long, _prefix long")
        ranged = slim.join(F.broadcast(goals), "_leaf").withColumn("_h", _order(plan, F.col("_epochs")))
        if step:
            ranged = ranged.where(F.shiftrightunsigned("_h", 64 - BITS * step) == F.col("_prefix"))
        # at most 2 ** BITS rows for a leaf of the tree come to the driver
        sums = ranged.groupBy("_leaf", F.shiftrightunsigned("_h", 64 - BITS * (step + 1)).cast("long").alias("_range")).agg(F.sum("_tokens").alias("n")).collect()
        found = {}
        for r in sorted(sums, key=lambda r: (r["_leaf"], r["_range"])):
            leaf = r["_leaf"]
            if leaf not in found:
                before = ends[leaf][1]
                if before + r["n"] > rest[leaf]:
                    found[leaf] = (r["_range"], before)
                else:
                    ends[leaf] = (ends[leaf][0], before + r["n"])
        ends = found
        if not ends:
            break
    # no end: the rest holds the whole epoch, which is an epoch of its own, so there is nothing to add
    return [(k, n, e, *ends.get(k, (-1, 0)), rest[k]) for k, n, e in rows]


def selected(rows: DataFrame, plan: Plan, cuts: list[tuple]) -> DataFrame:
    """Adds _copies to the rows of ``measured``. The cuts broadcast are one
    row per leaf of the tree."""
    spark = rows.sparkSession
    table = spark.createDataFrame(cuts, "_leaf string, _target long, _epochs long, _end long, _before long, _rest long")
    joined = rows.join(F.broadcast(table), "_leaf", "left").withColumn("_h", _order(plan, F.coalesce("_epochs", F.lit(0))))
    joined = joined.withColumn("_range", F.shiftrightunsigned("_h", 64 - BITS * STEPS).cast("long"))
    inside = "_leaf is not null and _epochs is not null and _range = _end"
    plain = joined.where(f"not coalesce({inside}, false)").withColumn("_copies", F.expr("coalesce(_epochs + int(_range < _end), 0)"))
    edge = joined.where(inside).withColumn("_high", F.shiftrightunsigned("_h", 1))
    edge = running(edge, ["_leaf"], ["_high", "_h", "doc_id", "_text_code"], "_tokens", "_upto")
    # a document of no words may follow the last that fits; it fits too
    edge = edge.withColumn("_copies", F.expr("_epochs + int(_before + _upto + _tokens <= _rest)")).drop("_upto", "_high")
    return plain.unionByName(edge)


def mixture(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row per input row: doc_id, domain, lang, source, n_tokens (words),
    target_tokens of its leaf (null outside the tree) and copies (how often
    the mixture holds it).

    Null languages and sources, like unlisted ones, are outside the tree and
    have 0 copies. Null and empty texts have 0 tokens and are taken where the
    order's prefix passes them. Rows with the same doc_id and text stand
    together in the order. An empty table gives an empty result.
    """
    slim = measured(docs, plan).select(F.col("doc_id").cast("long").alias("doc_id"), "_domain", "_lang", "_source", "_tokens", "_text_code", "_leaf")
    slim = stored(slim, "measured")
    out = selected(slim, plan, budgets(slim, plan))
    return out.select(
        "doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"),
        F.col("_target").alias("target_tokens"), F.col("_copies").cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with each row as often as the mixture holds it (see
    ``mixture``); columns may have any name."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    slim = stored(measured(docs, plan).select("doc_id", "_tokens", "_text_code", "_leaf"), "measured")
    taken = selected(measured(held, plan).drop("text"), plan, budgets(slim, plan)).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_nth")).select("_row.*")


def production_plan() -> Plan:
    """The weights of the registered query: four domains of five sources, the
    largest source at eight times its siblings' weight."""
    langs = {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1}
    domains = {"web": (0.46, range(0, 5)), "books": (0.18, range(5, 10)), "news": (0.18, range(10, 15)), "forum": (0.18, range(15, 20))}
    tree = {d: (w, {x: (y, {f"src{i}": 8 if i == 0 else 1 for i in own}) for x, y in langs.items()}) for d, (w, own) in domains.items()}
    number = "cast(substring(source, 4) as int)"
    domain = f"case when source not rlike '^src[0-9]{{1,3}}$' then null when {number} < 5 then 'web' when {number} < 10 then 'books' when {number} < 15 then 'news' else 'forum' end"
    return Plan(tree, domain)
