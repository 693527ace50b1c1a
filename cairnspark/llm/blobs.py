"""Packing of columns of numbers into binary values, so that a shuffle moves
a few large rows in place of many small ones."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array by plane (all lowest bytes first), which block
    compression takes better than whole values."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w, seed) for w in words], dtype=np.uint64)


def buckets_for(size_bytes: int, each_mb: int = 8, least: int = 16) -> int:
    """A power of two of buckets, so that each has a bounded share."""
    n = least
    while n * (each_mb << 20) < size_bytes and n < 1 << 24:
        n *= 2
    return n


#: A size that no estimate of a real table reaches.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Bytes that ``df`` reads, by the optimizer's sizes of its tables; what
    it thinks of joins and filters over them is left out. A table whose size
    it does not know is measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if max(sizes, default=0) < UNKNOWN:
        return sum(sizes)
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    row = F.lit(8 * len(df.columns)).cast("long")
    for w in wide:
        row = row + w
    return df.agg(F.sum(row)).first()[0] or 0


def gathered(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``which`` names, end to end, and their
    ends; run i has sizes[i] values."""
    if not len(which):
        return values[:0], np.zeros(0, np.int64)
    each = sizes[which]
    ends = np.cumsum(each)
    return values[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - each), each) + np.arange(ends[-1])], ends


#: Bytes of text that are worked on at once; a longer text stands alone.
SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE):
    """The batch in runs of rows whose texts have up to ``most`` bytes."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def tidied(run):
    """``run`` over Arrow batches, giving memory back when a task ends:
    workers outlive their tasks, and what one stage's tasks keep is missing
    in the next."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped
