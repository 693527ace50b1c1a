"""Approximate nearest neighbours by multi-index hashing.

A code has 128 bits: signs of the unit vector under rotations that are
learned from a bounded sample (iterative quantization, each from a start of
its own). The index holds every distinct vector once, in chunks; a chunk is
one row with its vectors and codes and, for each 8-bit substring of the
codes, a table of the rows by substring value. Of two codes within radius
r, some substring j differs in at most its share s_j of the bits, where the
shares and one for each substring but the first add up to r; so a query
fetches the rows of the values in a small ball around each of its
substrings, keeps those whose whole code is within the radius, and ranks
them by the cosine of the vectors. The radius is that of nearly all true
neighbours of a bounded sample of queries. Queries that find fewer than they
ask for within it are put to every vector, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import hash_sample, salted_join, stored
from .whitening import finite, vectors

#: Bits of a code and of a substring.
BITS, PIECE = 128, 8
PIECES = BITS // PIECE
#: Distinct vectors that the rotations are learned from at most.
SAMPLE = 16_384
#: Distinct queries that the radius is learned from at most, and the share of
#: their true neighbours that it has to cover.
TRIED, COVERED = 256, 0.96
#: Vectors of a chunk and queries of one pass over the index.
CHUNK, QUERIES = 32_768, 10_000
ROUNDS = 25
#: Sums of products that differ less may be in either order before the exact ones.
SLACK = 1e-9
SEED = 13


def learned_rotations(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """A (d, bits) matrix whose signs are the code of a vector: for as many
    rotations as the bits take, principal directions turned so that the
    sample's projections lie near the corners of the cube."""
    random = np.random.default_rng(seed)
    d = sample.shape[1]
    _, _, axes = np.linalg.svd(sample.T @ sample)
    out = []
    while bits:
        width = min(d, bits)
        base = axes[:width].T
        projected = sample @ base
        turn = np.linalg.qr(random.standard_normal((width, width)))[0]
        for _ in range(rounds):
            corners = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ corners)
            turn = left @ right
        out.append(base @ turn)
        bits -= width
    return np.hstack(out)


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in two steps so that no square overflows."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def codes(matrix: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(n, PIECES) bytes."""
    return np.packbits(units(matrix) @ rotations >= 0, axis=1)


def cosines(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The measure: each row's sum is worked out alike wherever it stands."""
    one, many = np.abs(vector).max(), np.abs(matrix).max(axis=1, keepdims=True)
    vector, matrix = vector / one, matrix / many
    return (matrix * vector).sum(axis=1) / (np.sqrt((matrix * matrix).sum(axis=1)) * np.sqrt((vector * vector).sum()))


def shares(radius: int) -> list[int]:
    """Bits that each substring may differ in; -1: not looked up."""
    low, more = divmod(radius, PIECES)
    return [low if j <= more else low - 1 for j in range(PIECES)]


_popcount = np.bitwise_count(np.arange(1 << PIECE, dtype=np.uint16))
#: Masks of the ball of each number of bits.
BALLS = [np.flatnonzero(_popcount <= s) for s in range(PIECE + 1)]


class Chunk:
    """One row of the index."""

    FIELDS = ("n", "firsts", "hashes", "vectors", "codes", "places", "starts")
    SCHEMA = "n int, firsts binary, hashes binary, vectors binary, codes binary, places binary, starts binary"

    def __init__(self, row: dict, d: int):
        self.n = row["n"]
        self.firsts = np.frombuffer(row["firsts"], "<i8")
        self.hashes = np.frombuffer(row["hashes"], "V16")
        self.vectors = np.frombuffer(row["vectors"], "<f8" if len(row["vectors"]) == 8 * d * self.n else "<f4").reshape(-1, d).astype(np.float64)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, PIECES)
        self.places = np.frombuffer(row["places"], "<u2").reshape(PIECES, -1)
        self.starts = np.frombuffer(row["starts"], "<u4").reshape(PIECES, -1)
        self.units = units(self.vectors)
        self._words = np.ascontiguousarray(self.codes).view("<u8")
        self._seen = np.zeros(self.n, bool)

    @staticmethod
    def built(firsts: np.ndarray, hashes: list[bytes], matrix: np.ndarray, wide: bool, rotations: np.ndarray) -> tuple:
        of = codes(matrix, rotations)
        places = np.stack([np.argsort(of[:, j], kind="stable") for j in range(PIECES)]).astype("<u2")
        starts = np.stack([np.concatenate([[0], np.cumsum(np.bincount(of[:, j], minlength=1 << PIECE))]) for j in range(PIECES)]).astype("<u4")
        return len(matrix), firsts.astype("<i8").tobytes(), b"".join(hashes), matrix.astype("<f8" if wide else "<f4").tobytes(), of.tobytes(), places.tobytes(), starts.tobytes()

    def distances(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self._words[rows] ^ code.view("<u8")).sum(axis=1, dtype=np.int32)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of all codes within the radius, by the tables."""
        seen = self._seen
        seen[:] = False
        for j, share in enumerate(shares(radius)):
            if share < 0:
                continue
            values = BALLS[min(share, PIECE)] ^ int(code[j])
            order, starts = self.places[j], self.starts[j]
            for a, b in zip(starts[values].tolist(), starts[values + 1].tolist(), strict=True):
                if a < b:
                    seen[order[a:b]] = True
        rows = np.flatnonzero(seen)
        far = self.distances(code, rows)
        near = far <= radius
        return rows[near], far[near]


FOUND = "query binary, hash binary, first long, score double, distance int"


class Best:
    """The ``most`` best vectors of each query so far: highest cosine first,
    ties to the smaller first id."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.kept: list[list[tuple]] = [[] for _ in range(queries)]

    def take(self, q: int, query: np.ndarray, unit: np.ndarray, chunk: Chunk, rows: np.ndarray, far: np.ndarray) -> None:
        near = chunk.units[rows] @ unit
        kept = self.kept[q]
        least = kept[-1][0] if len(kept) == self.most else -2.0
        if len(near) > self.most:
            least = max(least, np.partition(near, len(near) - self.most)[len(near) - self.most])
        some = np.flatnonzero(near >= least - SLACK)
        if not len(some):
            return
        rows, far = rows[some], far[some]
        new = zip(cosines(chunk.vectors[rows], query).tolist(), chunk.firsts[rows].tolist(), chunk.hashes[rows].tolist(), far.tolist(), strict=True)
        self.kept[q] = sorted([*kept, *new], key=lambda x: (-x[0], x[1], x[2]))[: self.most]

    def batch(self, keys: list[bytes]) -> pa.RecordBatch:
        rows = [(key, h, first, score, far) for key, kept in zip(keys, self.kept, strict=True) for score, first, h, far in kept]
        q, h, first, score, far = zip(*rows, strict=True) if rows else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(q, pa.binary()), pa.array(h, pa.binary()), pa.array(first, pa.int64()), pa.array(score, pa.float64()), pa.array(far, pa.int32())], names=["query", "hash", "first", "score", "distance"])


def _searching(keys: list[bytes], matrix: np.ndarray, rotations: np.ndarray, radius: int | None, most: int):
    """Per task the best vectors of each query; of all vectors where no
    radius is given."""
    of = codes(matrix, rotations)
    unit = units(matrix)

    def run(batches):
        best = Best(len(keys), most)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, matrix.shape[1])
                every = np.arange(chunk.n)
                for q in range(len(keys)):
                    rows, far = (every, chunk.distances(of[q], every)) if radius is None else chunk.within(of[q], radius)
                    if len(rows):
                        best.take(q, matrix[q], unit[q], chunk, rows, far)
        yield best.batch(keys)

    return run


class Index:
    """``chunks`` of all distinct vectors, ``members`` (hash, vec_id) of all
    rows, and what was learned: rotations and radius."""

    def __init__(self, chunks: DataFrame, members: DataFrame, d: int, rotations: np.ndarray, radius: int | None = None):
        self.chunks, self.members, self.d, self.rotations, self.radius = chunks, members, d, rotations, radius

    def _passes(self, queries: DataFrame, most: int, radius: int | None) -> DataFrame:
        """(query, hash, first, score, distance): the ``most`` best distinct
        vectors of each distinct query (hash, v). Queries come in blocks of
        bounded size."""
        n, out = -(-queries.count() // QUERIES), None
        for part in range(n):
            block = (queries.where(F.pmod(F.xxhash64("hash"), F.lit(n)) == part) if n > 1 else queries).collect()
            if not block:
                continue
            matrix = np.array([r["v"] for r in block], dtype=np.float64).reshape(len(block), self.d)
            found = self.chunks.mapInArrow(_searching([bytes(r["hash"]) for r in block], matrix, self.rotations, radius, most), FOUND)
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = queries.sparkSession.createDataFrame([], FOUND)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "hash")
        return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")

    def learn_radius(self, queries: DataFrame, k: int, tried: int = TRIED, covered: float = COVERED) -> int:
        """The least radius that covers the share ``covered`` of the true
        neighbours of at most ``tried`` distinct queries."""
        sample = hash_sample(queries.select("hash", "v"), ["hash"], tried, SEED)
        some = queries.sparkSession.createDataFrame([(bytes(r["hash"]), list(r["v"])) for r in sample], "hash binary, v array<double>")
        true = self._passes(some, k + 1, None).where("query <> hash")
        far = true.groupBy("distance").count().orderBy("distance").collect()
        need, got = covered * sum(r["count"] for r in far), 0
        for r in far:
            got += r["count"]
            if got >= need:
                return r["distance"]
        return 0

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, rank, vec_id, score) of ``queries`` (vec_id, hash, v),
        rows of the indexed table: the ``k`` nearest other rows found."""
        asked = queries.groupBy("hash").agg(F.first("v").alias("v"))
        if self.radius is None:
            self.radius = self.learn_radius(asked, k)
        found = stored(self._members(self._passes(asked, k + 1, self.radius), k + 1), "found")
        short = asked.join(found.where(F.size("found") > k).select("hash"), "hash", "left_anti")
        if not short.isEmpty():
            whole = self._members(self._passes(stored(short, "short"), k + 1, None), k + 1)
            found = found.where(F.size("found") > k).unionByName(whole)
        ids = queries.select(F.col("vec_id").alias("query_id"), "hash").distinct()
        each = salted_join(ids, found, ["hash"], F.xxhash64("query_id"))
        others = F.slice(F.filter("found", lambda x: (x.vec_id != F.col("query_id")) | (x.hash != F.col("hash"))), 1, k)
        return each.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")

    def _members(self, best: DataFrame, most: int) -> DataFrame:
        """(hash of the query, found: its ``most`` best rows in order). Of
        equal vectors no more than ``most`` rows can be among them."""
        place = Window.partitionBy("hash").orderBy("vec_id")
        ids = self.members.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most)
        ids = ids.groupBy("hash").agg(F.collect_list("vec_id").alias("ids"))
        best = stored(best.select("query", "hash", "score"), "best")  # read twice below
        rows = salted_join(best, ids, ["hash"], F.xxhash64("query")).select("query", "hash", "score", F.explode("ids").alias("vec_id"))
        rows = rows.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id", "hash", "score")).alias("found"))
        return rows.select(F.col("query").alias("hash"), F.slice(F.array_sort("found"), 1, most).alias("found"))


def _keyed(batches):
    """(vec_id, hash, d, v) of rows whose vector is finite and not zero. The
    hash is that of the bytes of the doubles."""
    for batch in batches:
        ids, column = batch.column("vec_id"), batch.column("v")
        for at, block in zip(*finite(column), strict=True):
            fit = block.any(axis=1)
            at, block = at[fit], np.ascontiguousarray(block[fit] + 0.0)
            if len(at):
                hashes = [xxhash.xxh3_128_digest(row.tobytes()) for row in block]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, block.size + 1, block.shape[1], dtype=np.int32)), pa.array(block.reshape(-1)).cast(column.type.value_type))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(hashes, pa.binary()), pa.array([block.shape[1]] * len(at), pa.int32()), rows], names=["vec_id", "hash", "d", "v"])


def _chunking(d: int, wide: bool, rotations: np.ndarray, size: int):
    def built(firsts, hashes, blocks):
        row = Chunk.built(np.concatenate(firsts), hashes, np.concatenate(blocks), wide, rotations)
        return pa.RecordBatch.from_pylist([dict(zip(Chunk.FIELDS, row, strict=True))], schema=pa.schema([("n", pa.int32()), *[(f, pa.binary()) for f in Chunk.FIELDS[1:]]]))

    def run(batches):
        firsts, hashes, blocks, n = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, min(size, batch.num_rows - at))
                if n + part.num_rows > size:
                    yield built(firsts, hashes, blocks)
                    firsts, hashes, blocks, n = [], [], [], 0
                firsts.append(part.column("first").to_numpy(zero_copy_only=False))
                hashes += part.column("hash").to_pylist()
                blocks.append(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
                n += part.num_rows
        if n:
            yield built(firsts, hashes, blocks)

    return run


def keyed(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, hash, d, v) of the rows that take part."""
    rows = vectors(table, id_col, vector_col).where("vec_id is not null and v is not null")
    kind = "double" if "double" in rows.schema["v"].dataType.simpleString() else "float"
    return rows.select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v")).mapInArrow(_keyed, f"vec_id long, hash binary, d int, v array<{kind}>")


def build(rows: DataFrame, sample: int = SAMPLE, chunk: int = CHUNK) -> Index | None:
    """The index of ``rows`` (see ``keyed``): every row is in it."""
    distinct = stored(rows.groupBy("hash", "d", "v").agg(F.min("vec_id").alias("first")), "distinct")
    size = distinct.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    d, own = size["d"], distinct.where(F.col("d") == size["d"])
    learned = hash_sample(own.select("hash", "v"), ["hash"], sample, SEED)
    rotations = learned_rotations(units(np.array([r["v"] for r in learned], dtype=np.float64)))
    wide = "double" in own.schema["v"].dataType.simpleString()
    chunks = stored(own.select("first", "hash", "v").mapInArrow(_chunking(d, wide, rotations, chunk), Chunk.SCHEMA), "chunks")
    members = rows.where(F.col("d") == d).select("hash", "vec_id").distinct()
    return Index(chunks, members, d, rotations)


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows, by cosine, of each row whose vec_id
    ``every`` divides: (query_id, rank, vec_id, score), ties to the smaller
    vec_id.

    Vectors that are null, empty, zero or hold a null, NaN or infinite entry
    take no part, nor do rows of a null vec_id and vectors of another length
    than most distinct ones have (the shorter on a tie). Repeated rows are
    one row; rows of one vec_id with different vectors are rows of their own,
    and a query leaves out only the row it is itself. Equal vectors are told
    by 128-bit hashes. Queries have as many rows as there are candidates, if
    fewer than ``k``; an empty table gives none. Columns not named here are
    not read."""
    rows = keyed(table, id_col, vector_col)
    index = build(rows)
    if index is None:
        return table.sparkSession.createDataFrame([], RESULT)
    return index.search(rows.where((F.col("d") == index.d) & (F.col("vec_id") % every == 0)).select("vec_id", "hash", "v"), k)


def recall(index: Index, queries: DataFrame, k: int = 5) -> float:
    """The share of the true ``k`` nearest distinct vectors of the stated
    queries (hash, v) that lie within the index's radius and are found."""
    true = index._passes(queries, k + 1, None).where("query <> hash")
    found = index._passes(queries, k + 1, index.radius).where("query <> hash")
    both = true.join(found, ["query", "hash"], "left_semi")
    return both.count() / max(1, true.count())
