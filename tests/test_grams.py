"""Substring meeting against all pairs."""

from __future__ import annotations

import random

from cairnspark.operators import grams
from cairnspark.plans import driver_queries as dq


def pairs(spark, hays, needles):
    h = spark.createDataFrame([(x, 1) for x in hays], "hay string, run int")
    n = spark.createDataFrame([(x, 2) for x in needles], "needle string, size int")
    return sorted((r["hay"], r["needle"]) for r in grams.contained(h, n).collect())


def by_force(hays, needles):
    return sorted({(h, n) for h in hays for n in needles if h is not None and n is not None and n in h})


def test_contained(spark):
    """Needles of none, one, two and more letters, absent ones, nulls,
    repeats, signs of two code units and a run that a third of all hays has."""
    r = random.Random(1)
    word = lambda most: "".join(r.choice("abcé😀") for _ in range(r.randint(0, most)))
    hays = [word(12) for _ in range(300)] + [f"commonpart{i}" for i in range(200)] + [None, "", "é"]
    needles = [word(5) for _ in range(120)] + ["commonpart", "part1", "zzz", "zz", "z", "", None, "commonpart7", "commonpart7"]
    assert pairs(spark, hays, needles) == by_force(hays, needles)
    some = [n for n in needles if n]
    assert pairs(spark, hays, some) == by_force(hays, some)
    assert pairs(spark, hays, []) == [] and pairs(spark, [], some) == []


def test_contained_by_shuffles(spark, monkeypatch):
    """Beyond the size that is sent to all tasks the rows are the same."""
    monkeypatch.setattr(grams, "SENT_ROWS", 0)
    monkeypatch.setattr(grams.small, "__defaults__", (0, 0))
    monkeypatch.setattr(grams, "HOT_ROWS", 3)
    hays, needles = [f"alpha{i}beta" for i in range(50)], ["ha1", "beta", "al", "9", "none"]
    assert pairs(spark, hays, needles) == by_force(hays, needles)


def test_no_pairs_in_the_plans(spark, sf):
    """Neither search nor the tests of a target compare all with all."""
    for name in ("batch_search", "benchmark_search", "recall_union", "substring_tests"):
        plan = dq.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
