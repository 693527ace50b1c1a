"""Substring deduplication by difference-cover anchors.

A window is 13 consecutive words. Only windows of 7 words at positions in
{0, 1, 3} modulo 7 are hashed. As every residue is a difference of two of
these, any two equal 13-word windows, wherever they start, hold anchors at
one common offset. Anchors that stand in two documents or more are extended:
the 13-word windows around them are compared, and a word goes if a window
over it also starts in a document with a smaller doc_id.

Each task settles what it can among its own documents, those it holds at once
and, of anchors and windows that were frequent in these, those that come
later. So a frequent key sends one document's entry a task and another's only
where that is smaller; a key that a document repeats is one entry too, and its
other places are found again where the document is read next. Entries travel
as packed arrays, by hash bucket.
Windows are compared by 128-bit hashes of 128-bit word hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored, texts
from .blobs import buckets_for, input_bytes, pack, tidied, unpack

WINDOW = 13
PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
#: Words a task holds at once; a longer document is held alone.
HELD_WORDS = 1 << 18
#: Frequent keys that a task remembers, the most frequent ones.
KNOWN_KEYS = 1 << 16
#: Bits of the fixed-size filter that spares most documents a second shuffle.
FILTER_BITS = 1 << 24
#: Null doc_ids come last in the order of documents.
LAST = np.iinfo(np.int64).max

ENTRY = "bucket int, settled boolean, lo binary, hi binary, doc binary, row binary, pos binary"


def word_codes(words: list[bytes]) -> np.ndarray:
    """128-bit hash of each word, as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, words)), dtype="<u8").reshape(-1, 2)


def window_codes(codes: np.ndarray, starts: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A 64-bit hash of ``length`` consecutive word codes at each start."""
    out = np.full(len(starts), salt, dtype=np.uint64)
    for k in range(length):
        out = (out ^ codes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)) ^ (out >> np.uint64(32))


def held_documents(batches, extra: str | None = None):
    """Lists of (doc, row key, words, extra), up to HELD_WORDS words each."""
    docs, n = [], 0
    for batch in batches:
        more = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
        for doc, row, text, x in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), more, strict=True):
            words = text.split()
            docs.append((LAST if doc is None else doc, row, words, x))
            n += len(words)
            if n >= HELD_WORDS:
                yield docs
                docs, n = [], 0
    if docs:
        yield docs


def entries(bucket: int, settled: bool, lo, hi, doc, row, pos) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array([bucket], pa.int32()), "settled": [settled], "lo": [pack(lo)], "hi": [pack(hi)], "doc": [pack(doc)], "row": [pack(row)], "pos": [pack(pos)]}
    )


def sent(buckets: int, settled: bool, lo, hi, doc, row, pos):
    """Entries dealt by the key's highest bits; settled ones by their document."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    to = (lo >> shift) if not settled else ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    order = np.argsort(to, kind="stable")
    to = to[order]
    for at, end in zip(*_runs(to), strict=True):
        part = order[at:end]
        key = part[:0] if settled else part
        yield entries(int(to[at]), settled, lo[key], hi[key], doc[part], row[part], pos[part])


def _runs(values: np.ndarray):
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.append(starts[1:], len(values))


def grouped(lo: np.ndarray, hi: np.ndarray):
    """Group number of each (lo, hi), and the number of groups."""
    order = np.lexsort((hi, lo))
    new = np.concatenate([[True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])]) if len(lo) else np.zeros(0, bool)
    group = np.empty(len(lo), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return group, int(new.sum())


def extent(group: np.ndarray, n: int, doc: np.ndarray):
    """Smallest and largest document of each group."""
    least, most = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, group, doc)
    np.maximum.at(most, group, doc)
    return least, most


def _anchors(buckets: int):
    def run(batches):
        known = Known()
        for docs in held_documents(batches):
            codes, starts, doc, row, pos = word_codes([w for d in docs for w in d[2]]), [], [], [], []
            at = 0
            for d, r, words, _ in docs:
                own = np.arange(max(0, len(words) - ANCHOR + 1))
                own = own[np.isin(own % PERIOD, COVER)]
                # a document of under WINDOW words has no window to extend to
                own = own if len(words) >= WINDOW else own[:0]
                starts.append(own + at)
                doc.append(np.full(len(own), d)), row.append(np.full(len(own), r)), pos.append(own)
                at += len(words)
            starts, doc, row, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, doc, row, pos))
            lo = window_codes(codes[:, 0], starts, ANCHOR, 1)
            yield from settled_and_sent(buckets, lo, np.zeros(len(lo), np.uint8), doc, row, pos.astype(np.int32), False, known)

    return run


class Known:
    """Keys that several documents of a task had so far, and the smallest of
    these documents."""

    def __init__(self):
        self.lo, self.hi, self.least, self.n = (np.zeros(0, t) for t in ("<u8", "<u8", "<i8", "<i8"))

    def find(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the smallest document of each."""
        if not len(self.lo):
            return np.zeros(len(lo), bool), np.full(len(lo), LAST)
        at = np.minimum(np.searchsorted(self.lo, lo), len(self.lo) - 1)
        there = (self.lo[at] == lo) & (self.hi[at] == hi)
        return there, np.where(there, self.least[at], LAST)

    def add(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, n: np.ndarray) -> None:
        """Keys in several documents, these entries among them."""
        lo, hi, least, n = (np.concatenate(x) for x in ((self.lo, lo), (self.hi, hi), (self.least, least), (self.n, n)))
        group, groups = grouped(lo, hi)
        first = np.zeros(groups, dtype=np.int64)
        first[group[::-1]] = np.arange(len(lo))[::-1]
        small, total = extent(group, groups, least)[0], np.bincount(group, weights=n, minlength=groups).astype(np.int64)
        if groups > KNOWN_KEYS:
            keep = np.sort(np.argpartition(-total, KNOWN_KEYS)[:KNOWN_KEYS])
            first, small, total = first[keep], small[keep], total[keep]
        lo, hi = lo[first], hi[first]
        order = np.argsort(lo, kind="stable")
        self.lo, self.hi, self.least, self.n = lo[order], hi[order], small[order], total[order]


def settled_and_sent(buckets, lo, hi, doc, row, pos, smaller: bool, known: Known):
    """What the task's documents settle among themselves, and what must meet
    the other tasks' entries.

    ``smaller`` False: an entry counts where its key is in two documents.
    All entries of a key that is shared here count; one of them is sent.
    ``smaller`` True: an entry counts where its key is in a smaller document.
    Entries of other documents than the smallest so far count; the smallest
    document's entries are sent.
    Of the equal keys of a document the first is sent, and its place p as
    -p - 2 if there are others (-1: counted here).
    """
    group, n = grouped(lo, hi)
    least, most = extent(group, n, doc)
    before, smallest = known.find(lo, hi)
    if smaller:
        done = doc > np.minimum(least[group], smallest)
        send, place = ~done, pos
    else:
        done = (least != most)[group] | before
        first = np.zeros(len(lo), bool)
        order = np.lexsort((doc, group))
        first[order[_runs(group[order])[0]]] = True
        send = (~done | first) & ~before
        place = np.where(done, np.int32(-1), pos)  # -1: already counted
    often = np.zeros(n, bool)
    often[group[before]] = True
    often |= least != most
    head = np.zeros(n, dtype=np.int64)
    head[group[::-1]] = np.arange(len(lo))[::-1]
    if often.any():
        known.add(lo[head][often], hi[head].astype(np.uint64)[often], least[often], np.bincount(group, minlength=n)[often])
    yield from sent(buckets, True, lo[done], hi[done], doc[done], row[done], pos[done])
    own = np.flatnonzero(send)
    own = own[np.lexsort((pos[own], row[own], doc[own], group[own]))]
    same = (group[own][1:] == group[own][:-1]) & (doc[own][1:] == doc[own][:-1]) & (row[own][1:] == row[own][:-1])
    head = own[np.concatenate([[True], ~same])] if len(own) else own
    again = np.zeros(len(lo), bool)
    again[own[:-1][same]] = True  # the next one is equal
    place = np.where(again & (place >= 0), -place - 2, place)
    yield from sent(buckets, False, lo[head], hi[head], doc[head], row[head], place[head])


def whole(places: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places as they stand, and those that stand for all of an equal key."""
    all_ = np.unique(np.array([p for x in places for p in x], dtype=np.int64))
    return all_[all_ >= 0], -all_[all_ < -1] - 2


FOUND = "doc_id long, row long, places array<int>"


def _met(smaller: bool):
    """One bucket: its entries that count, as places by document."""

    def run(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("settled").to_pylist(), dtype=bool)
        cols = {}
        for name, dtype in (("lo", "<u8"), ("hi", "<u8" if smaller else "u1"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<i4")):
            cols[name] = [unpack(x, dtype) for x in table.column(name).to_pylist()]
        take = lambda name, kind: np.concatenate([x for x, k in zip(cols[name], kinds, strict=True) if k == kind] or [np.zeros(0, cols[name][0].dtype)])
        lo, hi, doc, row, pos = (take(c, False) for c in ("lo", "hi", "doc", "row", "pos"))
        group, n = grouped(lo, hi)
        least, most = extent(group, n, doc)
        counts = (doc > least[group]) if smaller else (least != most)[group] & (pos != -1)
        doc, row, pos = (np.concatenate([x[counts], take(c, True)]) for c, x in (("doc", doc), ("row", row), ("pos", pos)))
        order = np.lexsort((pos, row, doc))
        doc, row, pos = doc[order], row[order], pos[order]
        starts, ends = _runs2(doc, row)
        return pa.table(
            {
                "doc_id": pa.array(doc[starts], pa.int64()),
                "row": pa.array(row[starts], pa.int64()),
                "places": pa.ListArray.from_arrays(pa.array(np.append(starts, len(pos)).astype(np.int32)), pa.array(pos, pa.int32())),
            }
        )

    return run


def _runs2(a: np.ndarray, b: np.ndarray):
    if not len(a):
        return np.zeros(0, int), np.zeros(0, int)
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return starts, np.append(starts[1:], len(a))


def _windows(buckets: int):
    """Extend shared anchors to the 13-word windows that hold them."""

    def run(batches):
        known = Known()
        for docs in held_documents(batches, "places"):
            codes, starts, doc, row, pos = word_codes([w for d in docs for w in d[2]]), [], [], [], []
            at = 0
            for d, r, words, places in docs:
                mark = np.zeros(len(words) + 1, dtype=np.int32)
                places, standing = whole(places)
                if len(standing):
                    anchors = np.arange(len(words) - ANCHOR + 1)
                    anchors = anchors[np.isin(anchors % PERIOD, COVER)]
                    equal = np.isin(window_codes(codes[:, 0], anchors + at, ANCHOR, 1), window_codes(codes[:, 0], standing + at, ANCHOR, 1))
                    places = np.concatenate([places, anchors[equal]])
                np.add.at(mark, np.maximum(places - (WINDOW - ANCHOR), 0), 1)
                np.add.at(mark, np.minimum(places + 1, len(words)), -1)
                own = np.flatnonzero(np.cumsum(mark) > 0)
                own = own[own <= len(words) - WINDOW]
                starts.append(own + at)
                doc.append(np.full(len(own), d)), row.append(np.full(len(own), r)), pos.append(own)
                at += len(words)
            starts, doc, row, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, doc, row, pos))
            lo, hi = window_codes(codes[:, 0], starts, WINDOW, 3), window_codes(codes[:, 1], starts, WINDOW, 5)
            yield from settled_and_sent(buckets, lo, hi, doc, row, pos.astype(np.int32), True, known)

    return run


def marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``near``: false only for rows whose document is not in ``found``.

    A bit set over the low bits of doc_ids, as a table of FILTER_BITS / 64
    words at most, which is what makes it fit to broadcast at any size; it
    has no false negative.
    """
    bit = f"(coalesce(doc_id, {LAST}L) & {FILTER_BITS - 1}L)"
    word, own = F.expr(f"shiftright({bit}, 6)").alias("_word"), f"shiftleft(1L, int({bit} & 63L))"
    words = found.select(word, F.expr(own).alias("_bit")).groupBy("_word").agg(F.expr("bit_or(_bit)").alias("_bits"))
    joined = rows.withColumn("_word", F.expr(f"shiftright({bit}, 6)")).join(F.broadcast(words), "_word", "left")
    return joined.withColumn("near", F.expr(f"coalesce(_bits, 0L) & {own} <> 0L")).drop("_word", "_bits")


def kept_words(words: list[bytes], places: np.ndarray) -> list[bytes]:
    """Words that no window at ``places`` covers."""
    mark = np.zeros(len(words) + 1, dtype=np.int32)
    places = np.unique(places)
    np.add.at(mark, places, 1)
    np.add.at(mark, np.minimum(places + WINDOW, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]


def every_place(words: list[bytes], places: list[list[int]]) -> np.ndarray:
    """Starts of the windows that go, those equal to a standing one included."""
    known, standing = whole(places)
    if not len(standing):
        return known
    codes, starts = word_codes(words), np.arange(len(words) - WINDOW + 1)
    lo, hi = window_codes(codes[:, 0], starts, WINDOW, 3), window_codes(codes[:, 1], starts, WINDOW, 5)
    group, n = grouped(lo, hi)
    gone = np.zeros(n, bool)
    gone[group[standing]] = True
    return np.concatenate([known, starts[gone[group]]])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            places = batch.column("places").to_pylist() if "places" in batch.schema.names else [None] * batch.num_rows
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), places, strict=True):
                words = text.split()
                kept = kept_words(words, every_place(words, own)) if own else words
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            n, gone, sha, left = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and,
    ``with_text``, kept_text.

    Null and empty texts have no word. Null doc_ids count as the largest.
    Rows that share a doc_id are rows of their own, told apart by a 64-bit
    hash of their text, and neither is smaller than the other. A very long
    text is held alone, whole. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    rows = rows.withColumn("row", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    buckets = buckets_for(input_bytes(docs), each_mb=2)
    anchors = rows.mapInArrow(tidied(_anchors(buckets)), ENTRY).groupBy("bucket").applyInArrow(_met(False), FOUND)
    gather = lambda found: found.groupBy("doc_id", "row").agg(F.collect_list("places").alias("places"))
    shared = stored(gather(anchors), "anchors")

    def beside(found: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
        """Rows the filter rules out, and the others joined to their places."""
        flagged = marked(rows, found)
        near = flagged.where("near").drop("near").withColumn("key", F.coalesce("doc_id", F.lit(int(LAST))))
        far = flagged.where("not near").drop("near")
        joined = near.join(found.select(F.col("doc_id").alias("key"), "row", "places"), ["key", "row"], how)
        return far, joined.select("doc_id", "row", "text", "places")

    _, extended = beside(shared, "inner")
    removed = stored(gather(extended.mapInArrow(tidied(_windows(buckets)), ENTRY).groupBy("bucket").applyInArrow(_met(True), FOUND)), "removed")
    untouched, touched = beside(removed, "left")
    return untouched.mapInArrow(tidied(_cut(with_text)), RESULT).unionByName(touched.mapInArrow(tidied(_cut(with_text)), RESULT))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, s, array_to_string(w[s:s + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d where len(w) >= 13)),
first as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, unnest(range(s, s + 13)) as p from win join first using (k) where m < doc_id),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1)::bigint as p from d),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""
