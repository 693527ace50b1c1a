"""SimHash near-duplicate grouping by multi-index hashing.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link at
2 differing bits or less. Every distinct fingerprint is entered by the value
of each of its segments; with two segments of 32 bits, a link differs in at
most one bit of the first or in none of the second. So each fingerprint looks
up the ball of one bit around its first segment and its second segment as it
stands, and every fetched match is checked by its complete distance. Of two
first segments one bit apart, the one without the bit looks the other up.

A segment value that more than ``crowded`` fingerprints share would give
pairs by the square. Fingerprints that look up such a value are linked by
the balls of one bit around the whole code instead: two of them within two
bits have a ball's member in common, and those that have one in common are
within two bits. Such a key has at most 65 fingerprints, which are kept as a
bit mask, so the way is exact and its work in proportion.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import clear_of, components, group_lookup, salted_join, shuffle_parts, stored, texts
from .blobs import LOWER, tidied

BLOCK = 1 << 15
#: Bits in which two fingerprints that link may differ.
RADIUS = 2
SEGMENTS = 2
#: A segment value of more fingerprints is looked up by whole codes.
CROWDED = 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text; 0 where it has no word."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    counts, n, codes = np.zeros(64, dtype=np.int64), 0, map(digest, grams, repeat(seed))
    while len(block := np.array(list(islice(codes, BLOCK)), dtype="<u8")):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        n += len(block)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        codes = np.array(found, dtype=np.uint64).view(np.int64)
        more = [c for c in batch.schema.names if c not in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes), *[batch.column(c) for c in more]], names=["doc_id", "fp", *more])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row, null texts as empty ones."""
    return texts(docs, id_col, text_col).mapInArrow(tidied(_fingerprints), "doc_id long, fp long")


def segment_widths(segments: int) -> list[tuple[int, int, int]]:
    """(shift, bits, ball radius) of the segments that are looked up: with
    radius 2 = r * segments + a, the first a + 1 at r and the others at
    r - 1, where that is a radius."""
    if not 2 <= segments <= 64:
        raise ValueError("2 to 64 segments")
    r, a = divmod(RADIUS, segments)
    base, more = divmod(64, segments)
    out, shift = [], 0
    for i in range(segments):
        bits = base + (i < more)
        if i <= a or r > 0:
            out.append((shift, bits, r if i <= a else r - 1))
        shift += bits
    return out


def _value(shift: int, bits: int) -> str:
    return f"(shiftrightunsigned(fp, {shift}) & {(1 << bits) - 1}L)" if bits < 64 else "fp"


def met(codes: DataFrame, segments: int, crowded: int) -> DataFrame:
    """Table matches: (fp, members, full); ``members`` are the fingerprints
    that have a segment value in the ball of ``fp``, itself among them, and
    empty where the value is shared by more than ``crowded``."""
    cut = segment_widths(segments)
    own = ", ".join(f"struct({i} as seg, {_value(s, n)} as value)" for i, (s, n, _) in enumerate(cut))
    balls = []
    for i, (s, n, r) in enumerate(cut):
        balls.append(f"array(struct({i} as seg, {_value(s, n)} as value))")
        if r:  # a bit that is not set is set: the other one's value
            unset = f"filter(sequence(0, {n - 1}), b -> shiftrightunsigned(fp, {s} + b) & 1L = 0L)"
            balls.append(f"transform({unset}, b -> struct({i} as seg, {_value(s, n)} | shiftleft(1L, b) as value))")
    entries = codes.select("fp", F.expr(f"inline(array({own}))"))
    sizes = entries.groupBy("seg", "value").agg(F.count("*").alias("n"))
    table = entries.join(sizes, ["seg", "value"]).groupBy("seg", "value").agg(F.collect_list(F.when(F.col("n") <= crowded, F.col("fp"))).alias("members"), (F.max("n") > crowded).alias("full"))
    found = codes.select("fp", F.expr(f"inline(concat({', '.join(balls)}))")).join(table, ["seg", "value"])
    return found.where("full or size(members) > 1 or members[0] <> fp").select("fp", "members", "full")


def crowd_links(codes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct ``fp`` within two bits, by the
    balls of one bit around whole codes: of each key a star from its smallest
    fingerprint."""
    keys = codes.select(F.expr("posexplode(concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b))))").alias("pos", "key"))
    table = keys.groupBy("key").agg(
        F.expr("bit_or(if(pos = 0, 0L, shiftleft(1L, pos - 1)))").alias("mask"),
        F.max(F.expr("pos = 0")).alias("own"),
    )
    found = table.where(F.expr("bit_count(mask) + int(own) > 1")).select(
        F.expr(
            "concat(if(own, array(key), array()), transform(filter(sequence(0, 63), b -> shiftrightunsigned(mask, b) & 1L = 1L), b -> key ^ shiftleft(1L, b)))"
        ).alias("members")
    )
    return found.select(F.array_min("members").alias("v"), F.explode("members").alias("u")).select("u", "v").where("u <> v")


def links(codes: DataFrame, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Links (u, v) that connect all distinct ``fp`` within two bits."""
    found = stored(met(codes, segments, crowded), "met")
    pairs = found.where("not full").select("fp", F.explode("members").alias("other")).where(f"fp <> other and bit_count(fp ^ other) <= {RADIUS}")
    pairs = pairs.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))
    return pairs.unionByName(crowd_links(found.where("full").select("fp").distinct())).distinct()


def classified(rows: DataFrame, segments: int, crowded: int) -> DataFrame:
    """(fp, component_id, group_size, root) of the distinct fingerprints of
    ``rows`` (doc_id, fp)."""
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "codes")
    # a code is a few bytes and has many keys: dealt out first, or few tasks would make them all
    roots = stored(components(links(codes.select("fp").repartition(shuffle_parts(rows), "fp"), segments, crowded)), "roots")
    placed = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root"))
    classes = group_lookup(
        placed, ["root"], F.col("fp"), {"component_id": (F.min("first_id"), F.min("component_id")), "group_size": (F.sum("n"), F.sum("group_size"))}
    )
    return stored(classes.select("fp", "component_id", "group_size", "root"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable by links) and group_size.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with the same doc_id are rows of their own; a null doc_id never is a
    component_id unless its whole component has none. Very long texts are
    fingerprinted in blocks. An empty table gives an empty result. A
    fingerprint that a third of all rows share is met by salted keys.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    found = salted_join(rows, classified(rows, segments, crowded), ["fp"], F.xxhash64("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that of the
    smallest doc_id, null last. Of several texts under this doc_id in the
    class, the one of the smallest hash stays, and of rows that repeat both
    doc_id and text any one. Null and empty texts are one class. An empty
    table gives an empty result. Columns of any name may be there."""
    names = docs.columns
    code = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = texts(docs, id_col, text_col).withColumn("code", F.xxhash64("text"))
    rows = stored(rows.mapInArrow(tidied(_fingerprints), "doc_id long, fp long, code long"), "fingerprints")
    classes = classified(rows.select("doc_id", "fp"), segments, crowded)
    # one row per fingerprint first, then one per class: no class is gathered
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code"))
    kept = rows.groupBy("fp").agg(first.alias("best")).join(classes, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = kept.select(F.coalesce("best.doc_id", F.lit(0)).alias("k_id"), F.col("best.none").alias("k_none"), F.col("best.code").alias("k_code"))
    own = clear_of(names, "_id", "_none", "_code")
    doc_id = F.col(f"`{id_col}`").cast("long")
    found = docs.withColumns({own[0]: F.coalesce(doc_id, F.lit(0)), own[1]: doc_id.isNull(), own[2]: code})
    found = found.join(kept, (found[own[0]] == kept.k_id) & (found[own[1]] == kept.k_none) & (found[own[2]] == kept.k_code), "left_semi")
    if rows.groupBy("doc_id", "code").count().where("count > 1").limit(1).count():
        found = found.dropDuplicates(own)
    return found.select(*[F.col(f"`{c}`") for c in names])
