"""A clustered vector index whose answers are exact.

Centres are fitted on a bounded sample of unit vectors; every vector is in
the list of its nearest centre, with its distance to it. A query's distance
to a vector is at least its distance to the centre less the vector's, and
so, once the k best so far are known, lists and vectors that cannot be nearer
are not read or compared. Cosine and distance of unit vectors order alike,
so nothing is lost.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import stored
from .manifests import Manifests
from .search import QUERIES_PER_PASS, top_per_key

#: Vectors that centres are fitted on at most, rounds of the fit, and centres
#: at most: about the square root of the vectors where that is less.
SAMPLE, ROUNDS, CENTRES = 20_000, 8, 1024
#: Lists of each query that are searched first; what they give bounds the rest.
FIRST = 4
#: Distances are worked out in double precision; nothing is skipped by less.
SLACK = 1e-9


def _units(rows: list) -> tuple[np.ndarray, np.ndarray]:
    m = np.array(rows, dtype=np.float64)
    lengths = np.linalg.norm(m, axis=1)
    return m / lengths[:, None], lengths


def fitted_centres(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``n`` centres of unit vectors by Lloyd's rounds."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T * 2 - (centres * centres).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (units * units).sum(axis=1)[:, None] - 2.0 * (units @ centres.T) + (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def _listing(centres: np.ndarray, schema: pa.Schema):
    d = centres.shape[1]

    def run(batches):
        for batch in batches:
            rows = batch.column("v").to_pylist()
            fit = [i for i, v in enumerate(rows) if v is not None and len(v) == d and None not in v and 0 < math.hypot(*v) < math.inf]
            if not fit:
                continue
            units, _ = _units([rows[i] for i in fit])
            far = _distances(units, centres)
            own = far.argmin(axis=1)
            some = batch.take(pa.array(fit))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), some.column("key"), some.column("v"), pa.array(far[np.arange(len(fit)), own])], schema=schema)

    return run


def _comparing(ids: list[int], matrix: np.ndarray, to_centre: np.ndarray, lists: dict[int, list[int]], bound: np.ndarray | None, most: int, key_kind: pa.DataType):
    """Per task the ``most`` best keys of the queries that want each list,
    and a row of no query with how many pairs were compared."""
    lengths = np.linalg.norm(matrix, axis=1)
    order = lambda x: (-x[1], x[0] is None, x[0])

    def take(best: dict, keys: list, sims: np.ndarray) -> dict:
        least = min(best.values()) if len(best) == most else -1.0
        for i in np.argsort(-sims, kind="stable").tolist():
            s = float(sims[i])
            if s < least:
                break
            if s > best.get(keys[i], -1.0):
                best[keys[i]] = s
                if len(best) > most:
                    best = dict(sorted(best.items(), key=order)[:most])
                least = min(best.values()) if len(best) == most else -1.0
        return best

    def run(batches):
        best: list[dict] = [{} for _ in ids]
        compared = 0
        for batch in batches:
            of, far = batch.column("list").to_numpy(zero_copy_only=False), batch.column("far").to_numpy(zero_copy_only=False)
            keys, rows = batch.column("key").to_pylist(), batch.column("v").to_pylist()
            for c in np.unique(of).tolist():
                own = np.flatnonzero(of == c)
                v = np.array([rows[i] for i in own], dtype=np.float64)
                norms = np.linalg.norm(v, axis=1)
                for q in lists.get(c, []):
                    near = np.arange(len(own)) if bound is None else np.flatnonzero(np.abs(to_centre[q, c] - far[own]) <= bound[q])
                    compared += len(near)
                    sims = 1.0 / (1.0 + (1.0 - (v[near] @ matrix[q]) / (norms[near] * lengths[q])))
                    best[q] = take(best[q], [keys[own[i]] for i in near.tolist()], sims)
        rows = [(None, None, None, compared)] + [(ids[q], key, s, None) for q, found in enumerate(best) for key, s in found.items()]
        kinds = (pa.int64(), key_kind, pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query_id", "key", "similarity", "compared"])

    return run


class VectorIndex:
    """Lists of vectors under ``root``, a folder that all executors share.
    The newest manifest names each list's folders and its least and largest
    distance; a change writes the lists that it touches, and readers see all
    of it or none. Zero vectors and such of another length than most, or with
    nulls or numbers that are not finite, match nothing and are not listed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Manifests(spark, root)

    def _state(self) -> dict:
        return self.files.read(self.files.newest())

    # --- writing ---

    def build(self, vectors: DataFrame, key: str = "key", centres: int | None = None, sample: int = SAMPLE) -> None:
        """Fit centres and list all ``vectors`` (key, embedding)."""
        base = self.files.newest()
        rows = vectors.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
        size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        d, n = (size["d"], size["count"]) if size else (0, 0)
        place = F.pmod(F.xxhash64("v"), F.lit(1 << 32))
        some = rows.where(F.size("v") == d).where(place < int(min(1.0, (1.2 * sample + 50) / max(n, 1)) * (1 << 32))).orderBy(place, "v").limit(sample)
        fit = [r["v"] for r in some.select("v").collect() if None not in r["v"] and 0 < math.hypot(*r["v"]) < math.inf]
        if not fit:
            self.files.commit(base, {"key": rows.schema["key"].dataType.simpleString(), "centres": [], "lists": {}})
            return
        middle = fitted_centres(_units(fit)[0], centres or max(1, min(CENTRES, math.isqrt(n))))
        state = {"key": rows.schema["key"].dataType.simpleString(), "centres": [[float(x) for x in c] for c in middle]}
        self.files.commit(base, state | {"lists": self._written(self._listed(rows, state), state)})

    def update(self, changed: DataFrame, key: str = "key", gone: DataFrame | None = None) -> int:
        """All vectors of the changed keys (key, embedding) in place of those
        there were, and none of the keys of ``gone`` (key). Only the lists that
        lose or gain a vector are written; their number."""
        base, state = self.files.newest(), self._state()
        rows = changed.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("v"))
        keys = rows.select("key").unionByName(gone.select(F.col(key).alias("key"))) if gone is not None else rows.select("key")
        keys = stored(keys.distinct(), "changed_keys")
        new = stored(self._listed(rows, state), "listed")
        lost = self._read(state).select("key", "list").join(keys, "key", "left_semi").select("list").distinct()
        touched = sorted(r[0] for r in lost.unionByName(new.select("list")).distinct().collect())
        kept = self._read(state, touched).join(keys, "key", "left_anti").unionByName(new)
        lists = {c: x for c, x in state["lists"].items() if int(c) not in touched}
        self.files.commit(base, state | {"lists": lists | self._written(kept, state)})
        return len(touched)

    def _listed(self, rows: DataFrame, state: dict) -> DataFrame:
        kinds = f"list int, key {state['key']}, v array<double>, far double"
        schema = pa.schema([("list", pa.int32()), ("key", to_arrow_type(rows.schema["key"].dataType)), ("v", pa.list_(pa.float64())), ("far", pa.float64())])
        return rows.mapInArrow(_listing(np.array(state["centres"]), schema), kinds)

    def _written(self, listed: DataFrame, state: dict) -> dict:
        """Write lists by ranges of distance, so that a large one is several
        tasks' and files'; what the manifest says of them."""
        name = uuid.uuid4().hex
        listed.repartitionByRange("list", "far").sortWithinPartitions("list", "far").write.partitionBy("list").parquet(f"{self.files.root}/{name}")
        made = {f[5:]: [f"{name}/{f}"] for f in self.files.folders(name) if f.startswith("list=")}
        if not made:
            return {}
        far = self.spark.read.schema(f"far double, list int").parquet(f"{self.files.root}/{name}").groupBy("list").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
        return {str(r["list"]): {"folders": made[str(r["list"])], "low": r["low"], "high": r["high"], "n": r["n"]} for r in far.collect()}

    # --- reading ---

    def _read(self, state: dict, lists: list[int] | None = None) -> DataFrame:
        out, by_write = None, {}
        for c, x in state["lists"].items():
            if lists is None or int(c) in lists:
                for folder in x["folders"]:
                    by_write.setdefault(folder.split("/")[0], []).append(folder)
        for write, folders in by_write.items():
            one = self.spark.read.option("basePath", f"{self.files.root}/{write}").schema(f"key {state['key']}, v array<double>, far double, list int").parquet(*[f"{self.files.root}/{f}" for f in folders])
            out = one if out is None else out.unionByName(one)
        if out is None:
            out = self.spark.createDataFrame([], f"key {state['key']}, v array<double>, far double, list int")
        return out.select("list", "key", "v", "far")

    def search(self, queries: DataFrame, k: int = 10, least_over: int = 1, stats: dict | None = None) -> DataFrame:
        """As ``search.vector_topk`` of all vectors: (query_id, key,
        similarity, rank). ``stats`` takes the pairs of queries and vectors
        and those that were compared."""
        state = self._state()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q")).where("q is not null")
        n, out, d = -(-asked.count() // QUERIES_PER_PASS), None, len(state["centres"][0]) if state["centres"] else -1
        for part in range(n):
            block = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == part) if n > 1 else asked).collect()
            block = [r for r in block if len(r["q"]) == d and None not in r["q"] and 0 < math.hypot(*r["q"]) < math.inf]
            if block:
                found = self._block(state, [r["query_id"] for r in block], np.array([r["q"] for r in block], dtype=np.float64), k * least_over, stats)
                out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], f"query_id long, key {state['key']}, similarity double, rank int")
        return out.where(F.col("rank") <= k)

    def _block(self, state: dict, ids: list[int], matrix: np.ndarray, most: int, stats: dict | None) -> DataFrame:
        kinds = f"query_id long, key {state['key']}, similarity double, compared long"
        known = {int(c): x for c, x in state["lists"].items()}
        to_centre = _distances(_units(matrix)[0], np.array(state["centres"]))
        key_kind = to_arrow_type(self._read(state, []).schema["key"].dataType)

        def compared(wanted: dict[int, list[int]], bound: np.ndarray | None) -> DataFrame:
            rows = self._read(state, sorted(wanted))
            return stored(rows.mapInArrow(_comparing(ids, matrix, to_centre, wanted, bound, most, key_kind), kinds), "compared")

        def best(rows: DataFrame) -> DataFrame:
            each = rows.where("query_id is not null").groupBy("query_id", "key").agg(F.max("similarity").alias("similarity"))
            return top_per_key(each, ["query_id"], [F.desc("similarity"), F.col("key")], most)

        near = [sorted(known, key=lambda c, q=q: to_centre[q, c])[:FIRST] for q in range(len(ids))]
        wanted: dict[int, list[int]] = {}
        for q, lists in enumerate(near):
            for c in lists:
                wanted.setdefault(c, []).append(q)
        rows = compared(wanted, None)
        least = {r["query_id"]: r["similarity"] for r in best(rows).where(F.col("rank") == most).select("query_id", "similarity").collect()}
        # similarity is 1 / (2 - cosine), and the square of the distance 2 - 2 cosine
        bound = np.array([math.sqrt(max(0.0, 2.0 / least[i] - 2.0)) + SLACK if i in least else math.inf for i in ids])
        rest: dict[int, list[int]] = {}
        for q in range(len(ids)):
            for c, x in known.items():
                if c not in near[q] and to_centre[q, c] - x["high"] <= bound[q] and x["low"] - to_centre[q, c] <= bound[q]:
                    rest.setdefault(c, []).append(q)
        if rest:
            rows = rows.unionByName(compared(rest, bound))
        if stats is not None:
            stats["pairs"] = stats.get("pairs", 0) + sum(x["n"] for x in known.values()) * len(ids)
            stats["compared"] = stats.get("compared", 0) + (rows.where("query_id is null").agg(F.sum("compared")).first()[0] or 0)
        return best(rows)
