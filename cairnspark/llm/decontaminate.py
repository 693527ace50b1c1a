"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased (A-Z) and separated by ASCII white space and
punctuation; shingles have five words, or all words of a shorter item. Only a
window that holds a shingle of the benchmark can resemble an item, so windows
of each item's size are taken around such shingles. A window's SimHash is
looked up in a multi-index of the items' SimHashes: the eight bytes are the
blocks, each item is entered under all byte values within ``radius // 8``
bits of its own, and so every item within ``radius`` bits of a window is
found. Its complete distance is checked next, and then the exact similarity:
shingles weighted by their number, sum of minima over sum of maxima. A
document of fewer shingles than an item is one window as a whole; it is
compared exactly, without fingerprints.

At a similarity of 0.8 the expected distance is under 10 bits and its
standard deviation under 3; the default radius of 24 leaves out about one
such window in a million.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import clear_of, texts
from .blobs import tidied, word_hashes

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: A benchmark of more items is taken in blocks of about so many.
ITEMS_PER_PASS = 20_000
#: Shingles of a document that are fingerprinted together.
BLOCK = 1 << 14
#: Pairs of a window and an item that are looked up together.
CELLS = 1 << 22

_punctuation = bytes(c for c in range(33, 127) if not chr(c).isalnum())
PLAIN = bytes.maketrans(_punctuation + bytes(range(65, 91)), b" " * len(_punctuation) + bytes(range(97, 123)))
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def shingle_codes(hashes: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the runs of ``length`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(29))


def window_fingerprints(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of ``size`` consecutive shingles at each of the ascending
    starts. Only the stretches that windows cover are summed."""
    out = np.zeros(len(starts), dtype="<u8")
    cuts = np.flatnonzero((np.diff(starts) > size) | (starts[1:] // BLOCK != starts[:-1] // BLOCK)) + 1
    for own in np.split(np.arange(len(starts)), cuts):
        at, end = int(starts[own[0]]), int(starts[own[-1]]) + size
        bits = np.unpackbits(codes[at:end].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((end - at + 1, 64), dtype=np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
        s = starts[own] - at
        out[own] = np.packbits((sums[s + size] - sums[s]) * 2 > size, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int, bytes]], radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        by_size: dict[int, list] = defaultdict(list)
        for item, text in items:
            words = plain_words(text)
            if words:
                by_size[len(words)].append((item, shingle_codes(word_hashes(words), min(SHINGLE, len(words)))))
        self.sizes = {}
        near = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= radius // 8
        for size, group in by_size.items():
            m = len(group[0][1])
            prints = np.concatenate([window_fingerprints(c, np.zeros(1, np.int64), m) for _, c in group])
            tables = np.stack([near[:, prints.view(np.uint8).reshape(-1, 8)[:, b]] for b in range(8)])  # block, value, item
            self.sizes[size] = (m, [i for i, _ in group], [Counter(c.tolist()) for _, c in group], prints, np.packbits(tables, axis=2))
        self.known = {}
        for length in {min(SHINGLE, s) for s in self.sizes}:
            sized = [c for s, (_, _, bags, _, _) in self.sizes.items() if min(SHINGLE, s) == length for bag in bags for c in bag]
            codes = np.unique(np.array(sized, dtype=np.uint64))
            low = np.zeros(1 << 16, dtype=bool)
            low[codes & np.uint64(0xFFFF)] = True
            self.known[length] = (codes, low)

    def matches(self, hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, best similarity, its first start, windows that match)."""
        out = []
        for length, (known, low) in self.known.items():
            codes = shingle_codes(hashes, length)
            maybe = np.flatnonzero(low[codes & np.uint64(0xFFFF)])
            found = codes[maybe]
            hits = maybe[known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found]
            if len(hits):
                for size in self.sizes:
                    if min(SHINGLE, size) == length:
                        out += self._sized(codes, hits, size)
        return out

    def _sized(self, codes, hits, size):
        m, items, bags, prints, tables = self.sizes[size]
        if len(codes) < m:
            return self._whole(codes, len(hits), m, items, bags)
        mark = np.zeros(len(codes) + 1, dtype=np.int32)
        np.add.at(mark, np.maximum(hits - m + 1, 0), 1)
        np.add.at(mark, hits + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        starts = starts[starts <= len(codes) - m]
        # what two bags share is at most the window's shingles that some item has
        shared = np.zeros(len(codes) + 1, dtype=np.int64)
        shared[hits + 1] = 1
        np.cumsum(shared, out=shared)
        some = shared[starts + m] - shared[starts]
        starts = starts[some + 1e-9 >= self.similarity * (2 * m - some)]
        best: dict[int, list] = {}
        step = max(1, CELLS // len(items))
        for begin in range(0, len(starts), step):
            own = starts[begin : begin + step]
            found = window_fingerprints(codes, own, m)
            blocks = found.view(np.uint8).reshape(-1, 8)
            listed = tables[0][blocks[:, 0]]
            for b in range(1, 8):
                listed |= tables[b][blocks[:, b]]
            at, which = np.nonzero(np.unpackbits(listed, axis=1)[:, : len(items)])
            near = _POP[(found[at] ^ prints[which]).view(np.uint8).reshape(-1, 8)].sum(axis=1) <= self.radius
            last = window = None
            for w, k in zip(own[at[near]].tolist(), which[near].tolist(), strict=True):
                if w != last:
                    last, window = w, Counter(codes[w : w + m].tolist())
                both = sum((window & bags[k]).values())
                s = both / (2 * m - both)
                if s >= self.similarity:
                    x = best.setdefault(k, [s, w, 0])
                    x[2] += 1
                    if s > x[0]:
                        x[:2] = s, w
        return [(items[k], *x) for k, x in best.items()]

    def _whole(self, codes, some, m, items, bags):
        """A document of fewer shingles than the items have, ``some`` of them
        known: their sum of maxima is of unequal sizes."""
        n = len(codes)
        if some + 1e-9 < self.similarity * (n + m - some):
            return []
        window, out = Counter(codes.tolist()), []
        for item, bag in zip(items, bags, strict=True):
            both = sum((window & bag).values())
            s = both / (n + m - both)
            if s >= self.similarity:
                out.append((item, s, 0, 1))
        return out

    def of(self, text: bytes) -> list[tuple[int, float, int, int]]:
        words = plain_words(text)
        return sorted(self.matches(word_hashes(words))) if words else []


def passes(benchmark: DataFrame, radius: int, similarity: float):
    """Indexes over the whole benchmark, each of a bounded number of items."""
    items = texts(benchmark, "item_id").distinct()
    blocks = -(-items.count() // ITEMS_PER_PASS)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == k).collect()
        yield Index(sorted(((r["doc_id"], r["text"].encode()) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1])), radius, similarity)


def _found(shared):
    def run(batches):
        index: Index = shared.value
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True) for m in index.of(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "item_id", "similarity", "start", "n_windows"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it repeats: doc_id,
    item_id, similarity of the best window, start (its first word, counted
    in words) and n_windows at or over ``similarity``. A document shorter than
    the item is its own single window.

    Null, empty and wordless texts and items match nothing. Repeated rows of
    ``docs`` give repeated results; equal items with different ids are found
    each. An empty benchmark gives an empty result.
    """
    rows, sc = texts(docs, id_col, text_col), docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, similarity double, start long, n_windows long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in passes(benchmark, radius, similarity):
        out = out.unionByName(rows.mapInArrow(tidied(_found(sc.broadcast(index))), schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that repeat no item, with all their columns; each
    row is judged where it stands, so nothing is joined or shuffled. Null,
    empty and wordless texts stay, repeated rows are judged each, a benchmark
    of no item leaves ``docs`` as it is, and columns may have any name."""
    names, sc = docs.columns, docs.sparkSession.sparkContext
    (judged,) = clear_of(names, "_judged")

    def clean(shared):
        def run(batches):
            index: Index = shared.value
            for batch in batches:
                good = [not index.of(t) for t in batch.column(judged).cast(pa.binary()).to_pylist()]
                yield batch.select(names).filter(pa.array(good, pa.bool_()))

        return run

    out = docs
    for index in passes(benchmark, radius, similarity):
        out = out.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(judged)).mapInArrow(tidied(clean(sc.broadcast(index))), docs.schema)
    return out
