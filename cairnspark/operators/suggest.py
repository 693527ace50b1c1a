"""Suggestions for names that were not found.

The ratio of two strings is twice their matched signs over both lengths. At
the cutoff in use (0.55) close names need not share a word, a run of two
signs or a first sign, so no key finds all pairs. What does hold is that no
more signs can match than the two have in common, each counted as often as
both have it. So the stated references meet the names in blocks: lengths and
counts of signs give each pair's best possible ratio, pairs are compared in
falling order of it, and a reference is done as soon as no other name can
enter its list.
"""

from __future__ import annotations

import difflib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import QUERIES_PER_PASS, top_per_key

#: Bins that signs are counted in; signs that share one only raise the bound.
BINS = 64


def tail(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def counts(names: list[str]) -> np.ndarray:
    """How often each bin's signs occur in each name."""
    sizes = np.array([len(n) for n in names], dtype=np.int64)
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4") % BINS
    rows = np.repeat(np.arange(len(names)), sizes)
    return np.bincount(rows * BINS + codes, minlength=len(names) * BINS).reshape(-1, BINS).astype(np.int32)


class Closest:
    """The ``most`` closest names of each reference so far: highest ratio
    first, the later name on a tie."""

    def __init__(self, refs: list[str], most: int, cutoff: float):
        self.refs, self.most, self.cutoff = refs, most, cutoff
        self.kept: list[list[tuple[float, str]]] = [[] for _ in refs]
        self._counts = counts(refs)
        self._matchers = [difflib.SequenceMatcher(None, "", r) for r in refs]
        self.compared = 0

    def take(self, names: list[str]) -> None:
        table, sizes = counts(names), np.array([len(n) for n in names], dtype=np.int64)
        for q, ref in enumerate(self.refs):
            kept = self.kept[q]
            least = kept[0][0] if len(kept) == self.most else self.cutoff
            total = sizes + len(ref)
            with np.errstate(invalid="ignore"):
                able = np.flatnonzero(2.0 * np.minimum(sizes, len(ref)) >= least * total)
            common = np.minimum(table[able], self._counts[q]).sum(axis=1)
            bound = np.where(total[able] > 0, 2.0 * common / np.maximum(total[able], 1), 1.0)
            order = np.argsort(-bound, kind="stable")
            for i in order.tolist():
                if bound[i] < (kept[0][0] if len(kept) == self.most else self.cutoff):
                    break
                matcher, name = self._matchers[q], names[able[i]]
                matcher.set_seq1(name)
                self.compared += 1
                found = (matcher.ratio(), name)
                if found[0] < self.cutoff:
                    continue
                if len(kept) < self.most:
                    heapq.heappush(kept, found)
                elif found > kept[0]:
                    heapq.heapreplace(kept, found)


def _closest(refs: list[str], most: int, cutoff: float):
    def run(batches):
        best = Closest(refs, most, cutoff)
        for batch in batches:
            best.take(batch.column("name").to_pylist())
        rows = [(ref, name, ratio) for ref, kept in zip(refs, best.kept, strict=True) for ratio, name in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["ref", "name", "ratio"])

    return run


def close_matches(refs: DataFrame, names: DataFrame, most: int = 5, cutoff: float = 0.55) -> DataFrame:
    """(ref, name, ratio, rank): of each distinct reference the ``most``
    closest distinct names. A task keeps ``most`` names of a reference, so
    that many rows a task and reference meet."""
    asked = refs.select("ref").where("ref is not null").distinct()
    given = names.select("name").where("name is not null").distinct()
    n, out = -(-asked.count() // QUERIES_PER_PASS), None
    for part in range(n):
        block = sorted(r[0] for r in (asked.where(F.pmod(F.xxhash64("ref"), F.lit(n)) == part) if n > 1 else asked).collect())
        if block:
            found = given.mapInArrow(_closest(block, most, cutoff), "ref string, name string, ratio double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = refs.sparkSession.createDataFrame([], "ref string, name string, ratio double")
    return top_per_key(out, ["ref"], [F.desc("ratio"), F.desc("name")], most)


def close_names(refs: DataFrame, names: DataFrame, most: int = 5, cutoff: float = 0.55) -> DataFrame:
    """(ref, suggestion, rank): names of the reference's last segment first,
    in order, then the closest ones, ``most`` in all."""
    # of a frequent segment no more names can be suggested
    named = top_per_key(names.select("name").where("name is not null").distinct().withColumn("_tail", tail(F.col("name"))), ["_tail"], [F.col("name")], most, "_n")
    direct = refs.select("ref").distinct().withColumn("_tail", tail(F.col("ref"))).join(named, "_tail").select("ref", "name", F.lit(0).alias("_kind"), "_n")
    close = close_matches(refs, names, most, cutoff).select("ref", "name", F.lit(1).alias("_kind"), F.col("rank").alias("_n"))
    both = direct.unionByName(close).groupBy("ref", "name").agg(F.min(F.struct("_kind", "_n")).alias("_o"))
    return top_per_key(both, ["ref"], [F.col("_o")], most).select("ref", F.col("name").alias("suggestion"), "rank")
