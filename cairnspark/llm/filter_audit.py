"""How quality filters interact: what each removes at each place of each order.

Filters stand for the bits of a mask. Every document is one mask of the
filters it fails; documents of one part, mask and label merge where they are
read, so from there on the work is bounded by parts, not by rows. A run of
the filters is a path through the lattice of subsets: at each step some
filters have been applied and one comes next. The cells contribute to each
of the k * 2^(k-1) edges (applied subset, next filter) of the lattice, and
the aggregated edges are joined to the k * k! steps of all orders.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACES, group_lookup, stored, texts

#: A filter that needs the whole table, not a text alone: identical to the
#: text of a smaller doc_id.
REPEATED = "repeated"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


#: Failure conditions by letter, each of (text, its words).
FILTERS: dict[str, object] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
    "C": lambda text, words: (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long") * 100 > F.length(text).cast("long") * 3,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
    "E": REPEATED,
}


def failures(docs: DataFrame, filters: Mapping[str, object] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, fails): the mask of the filters that each document
    fails, the first filter as the lowest bit. One row per row of ``docs``."""
    rows = texts(docs, id_col, text_col, part_col)
    rows = rows.select("doc_id", "text", F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), _words(F.col("text")).alias("words"))
    mask = F.lit(0)
    for bit, rule in enumerate(filters.values()):
        if rule is not REPEATED:
            mask = mask + F.when(rule(F.col("text"), F.col("words")), 1 << bit).otherwise(0)
    whole = [bit for bit, rule in enumerate(filters.values()) if rule is REPEATED]
    if not whole:
        return rows.select("doc_id", "part", mask.alias("fails"))
    narrow = stored(rows.select("doc_id", "part", mask.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")), "failures")
    first = group_lookup(narrow, ["digest"], F.col("doc_id"), {"first": (F.min("doc_id"), F.min("first"))})
    again = F.when(F.col("first") < F.col("doc_id"), sum(1 << b for b in whole)).otherwise(0)
    return first.select("doc_id", "part", (F.col("fails") + again).alias("fails"))


def cells(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by (part, fails, good, toxic) with their number ``n``. A
    document is good, or toxic, if any of its labels says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).where("doc_id is not null and (good or toxic)")
    seen = failing.join(known, "doc_id", "left")
    return seen.groupBy("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def edges(counted: DataFrame, names: list[str]) -> DataFrame:
    """Per part and lattice edge (``done``: mask of the filters applied,
    ``step_filter``: the next one) what becomes of the part's documents."""
    all_edges = F.array(*[F.struct(F.lit(done).alias("done"), F.lit(bit).alias("bit"), F.lit(1 << bit).alias("own")) for done in range(1 << len(names)) for bit in range(len(names)) if not done >> bit & 1])
    each = counted.select("*", F.explode(all_edges).alias("e"))
    own = F.col("e.own")
    reached, failing = F.col("fails").bitwiseAND(F.col("e.done")) == 0, F.col("fails").bitwiseAND(own) != 0

    def total(rule: Column) -> Column:
        return F.sum(F.when(rule, F.col("n")).otherwise(0))

    return each.groupBy("part", F.col("e.done").alias("done"), F.col("e.bit").alias("bit")).agg(
        total(reached & ~failing).alias("kept"),
        total(reached & failing).alias("removed"),
        total(failing & ~reached).alias("redundant"),
        total(F.col("fails") == own).alias("unique_fails"),
        total(reached & failing & F.col("good")).alias("good_lost"),
        total(reached & failing & F.col("toxic")).alias("toxic_lost"),
    )


def paths(spark, names: list[str]) -> DataFrame:
    """The steps of every order: (filter_order, step, done, bit)."""
    rows = []
    for order in permutations(range(len(names))):
        done = 0
        for step, bit in enumerate(order, 1):
            rows.append(("".join(names[b] for b in order), step, done, bit))
            done |= 1 << bit
    return spark.createDataFrame(rows, "filter_order string, step int, done int, bit int")


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, object] = FILTERS, part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost (long), and shapley, the
    filter's removed summed over all orders.

    Null and empty texts have no word and fail only what an empty text fails
    (too few words, repeated); white space alone likewise. A null part is the
    empty string's. Rows of a null doc_id have no label, repeat nothing and
    are repeated by nothing; rows of one doc_id are documents of their own
    that do not repeat each other. Texts are the same when their SHA-256 is.
    Labels without a document, null ones and repeated ones change nothing but
    that any label counts. An empty table has no part and so no row. Columns
    not named here are not read."""
    names = list(filters)
    counted = cells(failures(docs, filters, part_col=part_col), labels)
    found = edges(counted, names)
    steps = found.join(F.broadcast(paths(docs.sparkSession, names)), ["done", "bit"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


_orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
SQL = rf"""with labelled as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, trim(coalesce(text, ''), e' \t\n\x0b\x0c\r') as bare from documents),
w as (select *, case when bare = '' then [] else string_split_regex(bare, '[\x20\x09-\x0D]+') end as words, min(doc_id) over (partition by text) as first from d),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end ||
  case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 'C' else '' end ||
  case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when coalesce(first < doc_id, false) then 'E' else '' end as fails
  from w left join labelled using (doc_id)),
c as (select part, fails, good, toxic, count(*) as n from f group by all),
s as (select filter_order, step, filter_order[step] as letter, filter_order[1:step - 1] as before from (values {_orders}) o(filter_order), range(1, 6) r(step)),
x as (select part, filter_order, step, letter, good, toxic, n, fails, contains(fails, letter) as failing, translate(before, fails, '') = before as reached from c, s),
y as (select part, filter_order, step, letter,
  coalesce(sum(n) filter (reached and not failing), 0) as kept, coalesce(sum(n) filter (reached and failing), 0) as removed,
  coalesce(sum(n) filter (failing and not reached), 0) as redundant, coalesce(sum(n) filter (fails = letter), 0) as unique_fails,
  coalesce(sum(n) filter (reached and failing and good), 0) as good_lost, coalesce(sum(n) filter (reached and failing and toxic), 0) as toxic_lost
  from x group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from y"""
