"""Suggestions against difflib over all pairs, and exact vector lists."""

from __future__ import annotations

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from cairnspark.operators import search, suggest
from cairnspark.operators.vector_index import VectorIndex
from cairnspark.plans import driver_queries as dq


def all_pairs(ref, names, most=5, cutoff=0.55):
    names = sorted(set(names))
    tail = ref.split(".")[-1]
    out = [n for n in names if n == tail or n.endswith(f".{tail}")]
    out += difflib.get_close_matches(ref, names, n=most, cutoff=cutoff)
    return list(dict.fromkeys(out))[:most]


def suggested(df):
    out: dict = {}
    for r in df.orderBy("ref", "rank").collect():
        out.setdefault(r["ref"], []).append(r["suggestion"])
    return out


def words(n, seed):
    r = random.Random(seed)
    parts = ["get", "user", "svc", "order", "total", "build", "text", "é", "x", "notify", "Service"]
    return [r.choice(["m", "shop.api", "shop"]) + "." + r.choice(["_", ""]).join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]


def test_as_all_pairs(spark):
    names = words(400, 1) + ["user_service", "get_user", "", "a" * 3000, "dup", "dup"]
    refs = words(60, 2) + ["usr_svc", "getuser", "", "zzz", "x.build", "a" * 2900, None]
    got = suggested(suggest.close_names(spark.createDataFrame([(x,) for x in refs], "ref string"), spark.createDataFrame([(x,) for x in [*names, None]], "name string")))
    want = {x: all_pairs(x, names) for x in refs if x is not None}
    assert got == {x: v for x, v in want.items() if v}
    assert "user_service" in got["usr_svc"] or "user_service" in want["usr_svc"] or len(want["usr_svc"]) == 5
    none = spark.createDataFrame([], "name string")
    assert suggest.close_names(spark.createDataFrame([("a",)], "ref string"), none).count() == 0 and suggest.close_names(none.withColumnRenamed("name", "ref"), none).count() == 0


def test_part_names(spark, sf):
    """Equal to all pairs, with few of these compared."""
    found = suggested(dq.QUERIES["name_suggestions"](spark, sf))
    names = sorted({r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select(F.lower("p_name")).collect()})
    assert found and all(found[ref] == all_pairs(ref, names) for ref in found)
    near = suggest.Closest(sorted(found), 5, 0.55)
    near.take(names)
    assert near.compared < 0.8 * len(names) * len(found)


def test_more_names_cost_few_comparisons():
    names = words(3000, 5)
    near = suggest.Closest(["shop.get_user_order", "shop.api.notifyService"], 5, 0.55)
    near.take(sorted(set(names)))
    assert near.compared < 0.25 * 2 * len(set(names))
    assert [n for _, n in sorted(near.kept[0], reverse=True)] == difflib.get_close_matches("shop.get_user_order", sorted(set(names)), n=5, cutoff=0.55)


def clustered(n=1500, d=12):
    r = np.random.default_rng(4)
    middle = r.normal(size=(30, d))
    return [(i, [float(x) for x in middle[i % 30] * r.uniform(0.5, 2) + 0.03 * r.normal(size=d)]) for i in range(n)]


def rows(df):
    return [(r["query_id"], r["rank"], r["key"], round(r["similarity"], 12)) for r in df.orderBy("query_id", "rank").collect()]


def test_vector_lists(spark, tmp_path):
    """As the scan finds, with most vectors left out; keys of several vectors,
    ties, vectors that match nothing, updates."""
    data = clustered() + [(7, [float(x) for x in np.ones(12)]), (5000, None), (5001, [0.0] * 12), (5002, [1.0]), (5003, [float("nan")] * 12)] + [(6000 + i, clustered(1)[0][1]) for i in range(20)]
    frame = lambda some: spark.createDataFrame(some, "key int, embedding array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in data if i % 100 == 0] + [(9, [0.0] * 12), (10, [1.0, 2.0]), (11, None)], "query_id long, vector array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(frame(data))
    stats: dict = {}
    assert rows(index.search(asked, 5, stats=stats)) == rows(search.vector_topk(frame(data), asked, 5))
    assert stats["compared"] < 0.4 * stats["pairs"]
    changed = [(i, [x + 0.5 for x in v]) for i, v in data[:3]] + [(7000, data[50][1])]
    assert index.update(frame(changed), gone=frame([(50, None), (9999, None)]).select("key")) <= 10
    now = [x for x in data if x[0] not in (0, 1, 2, 50)] + changed
    assert rows(index.search(asked, 5)) == rows(search.vector_topk(frame(now), asked, 5))
    assert rows(index.search(asked, 2000)) == rows(search.vector_topk(frame(now), asked, 2000))


def test_vector_lists_of_nothing(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(spark.createDataFrame([(1, None)], "key int, embedding array<float>"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")).count() == 0
