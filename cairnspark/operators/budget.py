"""Payloads made to fit a budget of characters, one row a request.

A payload is a fixed part and some lists of items; an item is a map of
strings. Steps apply in order, each only while the payload is too long:
``Halve`` keeps the first half of a list, again and again down to ``least``
items; ``Drop`` and ``Keep`` take fields from a list's items; ``Clip`` cuts
their values. Sizes are those of the JSON text with a blank after each comma
and colon. A list's sizes after each halving are sums over its first items,
so the number of halvings is found by a search over these, not by building
payloads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Halvings of the longest list there can be.
MOST_HALVINGS = 31


@dataclass(frozen=True)
class Halve:
    name: str
    list: str
    least: int = 1


@dataclass(frozen=True)
class Drop:
    name: str
    list: str
    field: str


@dataclass(frozen=True)
class Keep:
    name: str
    list: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Clip:
    name: str
    list: str
    chars: int


Step = Halve | Drop | Keep | Clip


def text_size(c: Column) -> Column:
    """Signs of a string's JSON text: quotes, and what is escaped."""
    # two signs for quotes, backslashes and the five short escapes, six for other control signs
    short = F.length(c) - F.length(F.translate(c, '"\\\b\f\n\r\t', ""))
    other = F.length(c) - F.length(F.translate(c, "".join(map(chr, [*range(8), 11, *range(14, 32)])), ""))
    return F.coalesce(F.length(c) + short + 5 * other + 2, F.lit(4))


def item_size(item: Column) -> Column:
    """Signs of a map's JSON text."""
    entries = F.aggregate(F.map_entries(item), F.lit(0), lambda acc, e: acc + text_size(e.key) + text_size(e.value) + 2)
    return entries + 2 + 2 * F.greatest(F.size(item) - 1, F.lit(0))


def _sum(sizes: Column, n: Column) -> Column:
    """A list's text but its brackets, of its first ``n`` items."""
    return F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0).cast("long"), lambda acc, x: acc + x) + 2 * F.greatest(n - 1, F.lit(0))


def _change(step: Drop | Keep | Clip):
    """What a step makes of an item."""
    if isinstance(step, Drop):
        return lambda item: F.map_filter(item, lambda k, _: k != step.field)
    if isinstance(step, Keep):
        return lambda item: F.map_filter(item, lambda k, _: k.isin(*step.fields))
    return lambda item: F.transform_values(item, lambda _, v: F.substring(v, 1, step.chars))


def reduced(df: DataFrame, fixed: Column, lists: list[str], steps: list[Step], limit: int, soft: float = 1.0) -> DataFrame:
    """``df`` with its ``lists`` (columns array<map<string, string>>, null as
    empty) cut to fit, ``size``, ``steps`` (names of the steps taken, once
    for each halving) and ``fits``: within ``limit``, or, all steps taken,
    within ``limit * soft``. ``fixed``: characters of the payload with its
    lists empty. Working columns begin with two underscores."""
    out = df.withColumn("__fixed", fixed.cast("long")).withColumn("__log", F.array().cast("array<string>"))
    for name in lists:
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<map<string,string>>"))).withColumn(f"__s_{name}", F.transform(name, item_size)).withColumn(f"__n_{name}", F.size(name))
    out = out.withColumn("__size", sum((_sum(F.col(f"__s_{name}"), F.col(f"__n_{name}")) for name in lists), F.col("__fixed")))
    for step in steps:
        name, n, sizes = step.list, F.col(f"__n_{step.list}"), F.col(f"__s_{step.list}")
        over = F.col("__size") > limit
        if isinstance(step, Halve):
            # kept after 0, 1, 2, ... halvings, as far as each changes anything
            kept = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(MOST_HALVINGS)), lambda j: F.greatest(F.floor(n / F.pow(F.lit(2.0), j)).cast("int"), F.least(n, F.lit(step.least)))))
            other = F.col("__size") - _sum(sizes, n)
            fit = F.array_position(F.transform(kept, lambda m: other + _sum(sizes, m) <= limit), True)
            at = F.when(~over, 1).when(fit > 0, fit).otherwise(F.size(kept)).cast("int")
            out = out.withColumn("__at", at).withColumn("__m", F.element_at(kept, F.col("__at")))
            out = out.withColumn("__size", other + _sum(sizes, F.col("__m"))).withColumn(f"__n_{name}", F.col("__m"))
            out = out.withColumn("__log", F.concat("__log", F.array_repeat(F.lit(step.name), F.col("__at") - 1)))
            continue
        first = F.slice(F.col(name), F.lit(1), n)
        out = out.withColumn("__x", F.when(over, F.transform(first, _change(step))).otherwise(first)).withColumn("__t", F.transform("__x", item_size))
        # a step that leaves all sizes as they were has changed nothing
        took = over & (F.col("__t") != F.slice(sizes, F.lit(1), n))
        out = out.withColumn("__log", F.when(took, F.concat("__log", F.array(F.lit(step.name)))).otherwise(F.col("__log")))
        out = out.withColumn("__size", F.col("__size") - _sum(sizes, n) + _sum(F.col("__t"), n)).withColumn(name, F.col("__x")).withColumn(f"__s_{name}", F.col("__t"))
    for name in lists:
        out = out.withColumn(name, F.slice(F.col(name), F.lit(1), F.col(f"__n_{name}")))
    out = out.withColumn("size", F.col("__size")).withColumn("steps", F.col("__log")).withColumn("fits", F.col("__size") <= limit * soft)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def first_fitting(variants: Column, limit: int) -> Column:
    """The place, from one, of the first of an array of texts that fits; 0 if
    none does."""
    return F.array_position(F.transform(variants, lambda v: F.length(v) <= limit), True)


def least_doc_chars(doc: Column, configured: Column, ratio: float) -> Column:
    """A document's own length, or more than the configured least if a share
    of it is more."""
    return F.least(doc, F.greatest(configured, F.floor(doc * ratio).cast("int")))
