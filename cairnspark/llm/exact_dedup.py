"""Exact deduplication by content-defined chunk recipes, in DataFrame
functions only.

A text is cut where the hash of a word says so, so equal passages give equal
chunks wherever they stand. Chunks are deduplicated first: each distinct one
moves once per map task, and the move verifies that an identifier stands for
one chunk text only. A document is then its ordered list of identifiers, and
only those lists are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACES, dropped, group_lookup, stored, texts

#: A piece is a word of up to 256 characters with the space that follows.
PIECE = r"(?s)[^ ]{1,256} ?| "
#: One word in so many ends a chunk; no chunk has more pieces than LONGEST.
EVERY, LONGEST = 64, 2048
#: Identifiers tried in turn until no two different chunks share one.
DIGESTS = {"xxhash64": lambda c: F.xxhash64(c), "sha256": lambda c: F.sha2(c, 256)}


def chunked(docs: DataFrame, id_col: str, text_col: str, every: int = EVERY) -> DataFrame:
    """doc_id, norm and chunks (array of strings that join to norm)."""
    norm = texts(docs, id_col, text_col).select("doc_id", F.regexp_replace("text", SPACES, " ").alias("norm"))
    # One-element transforms bind the pieces and the cuts once per row; as columns
    # of their own the optimizer would inline them into the lambdas below.
    prev = "if(k = 0, 0, cuts[k - 1])"
    cuts = f"filter(sequence(1, size(p)), i -> pmod(xxhash64(p[i - 1]), {every}) = 0 or i % {LONGEST} = 0 or i = size(p))"
    chunks = f"transform(array({cuts}), cuts -> transform(cuts, (c, k) -> array_join(slice(p, {prev} + 1, c - {prev}), '')))[0]"
    pieces = f"regexp_extract_all(norm, r'{PIECE}', 0)"
    return norm.withColumn("chunks", F.expr(f"if(norm = '', cast(array() as array<string>), transform(array({pieces}), p -> {chunks})[0])"))


def verified_digest(chunks: DataFrame, digests: dict = DIGESTS) -> str:
    """The first digest under which every identifier has one chunk text."""
    for name, digest in digests.items():
        # outer: a plain explode would also filter on the array, and so cut each text twice more
        distinct = chunks.select(F.explode_outer("chunks").alias("chunk")).distinct()
        clashes = distinct.groupBy(digest(F.col("chunk")).alias("id")).count().where("count > 1")
        if clashes.limit(1).count() == 0:
            return name
    raise ValueError("no digest identifies the chunks")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: dict = DIGESTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is one
    space; null counts as empty. The smallest doc_id of equal texts stays; a
    null doc_id stays only where its group has no other. Rows that repeat a
    doc_id and its text are all marked kept, being one document. Very long
    texts are chunked whole; an empty table gives an empty result.
    """
    # cut once: both the chunks' identifiers and the recipes read this table
    chunks = stored(chunked(docs, id_col, text_col).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "chunks"), "chunks")
    digest = digests[verified_digest(chunks, digests)]
    rows = stored(chunks.select("doc_id", "text_sha256", F.transform("chunks", lambda c: digest(c)).alias("recipe")), "recipes")
    dropped(chunks)
    grouped = group_lookup(
        rows.withColumn("code", F.xxhash64("recipe")),
        ["code", "recipe"],
        F.coalesce("doc_id", F.lit(0)),
        {"keep_id": (F.min("doc_id"), F.min("keep_id")), "group_size": (F.count(F.lit(1)), F.sum("group_size"))},
    )
    return grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id is not distinct from min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
