"""A lexical index as tables: postings in blocks with their best weights, and
top-k search that leaves out blocks below the k-th score.

A segment holds the documents of one write: ``rows`` (block, keys and where
each document lies), ``words`` (token), ``postings`` (token, block, best,
docs), where a posting is a document's place in its block and the largest
weight of a field that has the word, and ``files``, the range of words of each
file of postings. Segments are never changed;
an update writes a segment of the new and changed documents and of the keys
that went, and of each key only its newest segment counts. So the work of an
update follows the change, not the corpus. ``compact`` puts all segments
into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored
from . import grams, skipping
from .manifests import Manifests
from .search import query_words, top_per_key, word_matches, word_rows

#: Documents of a block.
BLOCK = 128
POSTINGS = "token string, block long, best int, n int, docs array<struct<doc:int,w:int>>"
#: Blocks of each query whose documents are scored first: they set the score
#: that other blocks have to reach.
FIRST = 4
#: Words of at most so many matches are put into the scan's filter and open
#: only the files that may hold them.
LISTED = 2_000


class Postings:
    """The index under ``root``, a folder that all executors share.

    ``key``: the columns that identify a document, of types that order;
    ``weights``: the fields and their weights, in hundredths of a point. A
    null field is empty; a repeated key counts once, its rows' words
    together; rows with a null key are not indexed."""

    def __init__(self, spark: SparkSession, root: str, key: Mapping[str, str], weights: Mapping[str, int]):
        self.spark, self.key, self.weights = spark, dict(key), dict(weights)
        self.files = Manifests(spark, root)

    # --- writing ---

    @property
    def segments(self) -> list[str]:
        return self.files.read(self.files.newest()).get("segments", [])

    def _write(self, name: str, docs: DataFrame, fields: Mapping[str, Column], gone: DataFrame | None) -> None:
        """One segment. Documents are dealt to blocks in the order of their
        keys, so that blocks are ranges of keys."""
        keys, root = list(self.key), f"{self.files.root}/segments/{name}"
        cast = {k: F.col(k).cast(t) for k, t in self.key.items()}
        known = docs.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in cast.values()]))
        # within a task keys are in order, and a task's documents fill its own blocks
        place = F.monotonically_increasing_id()
        placed = word_rows(known, fields, self.weights, cast, ranges=True).select(*keys, F.shiftright(place, 33).alias("_task"), (place % (1 << 33)).alias("_n"), "words")
        placed = stored(placed.select(*keys, ((F.col("_task") * (1 << 24)) + F.floor(F.col("_n") / BLOCK)).cast("long").alias("block"), (F.col("_n") % BLOCK).cast("int").alias("doc"), "words"), "places")
        dealt = placed.select(*keys, "block", "doc")
        rows = dealt.withColumn("gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(*[c.alias(k) for k, c in cast.items()]).distinct().join(dealt.select(*keys), keys, "left_anti").select(*keys, F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("doc"), F.lit(True).alias("gone")))
        rows.write.parquet(f"{root}/rows")
        self._write_lists(name, placed.select("block", "doc", F.explode("words").alias("_w")).select("_w.token", "block", "doc", "_w.w"))

    def _write_lists(self, name: str, each: DataFrame) -> None:
        """Postings of (token, block, doc, w) by ranges of words, which are
        shuffled once: a list lies in one range."""
        root = f"{self.files.root}/segments/{name}"
        lists = each.repartitionByRange("token", "block").groupBy("token", "block").agg(F.max("w").alias("best"), F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("doc", "w"))).alias("docs"))
        lists.sortWithinPartitions("token", "block").write.parquet(f"{root}/postings")
        written = self._part(name, "postings")
        written.select("token").distinct().write.parquet(f"{root}/words")
        skipping.file_stats(written, ["token"], filters=False).write.parquet(f"{root}/files")

    def _part(self, name: str, part: str) -> DataFrame:
        kinds = {
            "rows": ", ".join(f"{k} {t}" for k, t in self.key.items()) + ", block long, doc int, gone boolean",
            "words": "token string",
            "postings": POSTINGS,
            "files": skipping.SCHEMA,
        }
        return self.spark.read.schema(kinds[part]).parquet(f"{self.files.root}/segments/{name}/{part}")

    def _all(self, part: str) -> DataFrame | None:
        out = None
        for age, name in enumerate(self.segments):
            one = self._part(name, part).withColumn("segment", F.lit(age))
            out = one if out is None else out.unionByName(one)
        return out

    def build(self, docs: DataFrame, fields: Mapping[str, Column]) -> str:
        """An index of ``docs`` alone, whatever there was."""
        base, name = self.files.newest(), uuid.uuid4().hex
        self._write(name, docs, fields, None)
        self.files.commit(base, {"segments": [name]})
        return name

    def update(self, changed: DataFrame, fields: Mapping[str, Column], gone: DataFrame | None = None) -> str:
        """New and changed documents in place of those of their keys, and
        without the keys of ``gone``. Writes a segment of these alone."""
        base, name = self.files.newest(), uuid.uuid4().hex
        self._write(name, changed, fields, gone)
        self.files.commit(base, {"segments": [*self.segments, name]})
        return name

    def compact(self) -> str | None:
        """All segments as one, from their own postings: the documents are
        not read again."""
        base, name, keys = self.files.newest(), uuid.uuid4().hex, list(self.key)
        if len(self.segments) < 2:
            return None
        root = f"{self.files.root}/segments/{name}"
        live = self.live()
        blocks = stored(live.select("segment", "block").distinct().withColumn("to", F.monotonically_increasing_id()), "blocks")
        moved = stored(live.join(blocks, ["segment", "block"]), "moved")
        moved.select(*keys, F.col("to").alias("block"), "doc", F.lit(False).alias("gone")).write.parquet(f"{root}/rows")
        each = self._all("postings").select("segment", "token", "block", F.explode("docs").alias("d")).select("segment", "token", "block", "d.doc", "d.w")
        each = each.join(moved.select("segment", "block", "doc", "to"), ["segment", "block", "doc"]).select("token", F.col("to").alias("block"), "doc", "w")
        self._write_lists(name, each)
        self.files.commit(base, {"segments": [name]})
        return name

    def vacuum(self) -> int:
        """Delete segments that the newest manifest does not name, and older
        manifests. Not beside a writer or a reader of those."""
        used, numbers = set(self.segments), self.files.numbers()
        for n in numbers[:-1]:
            self.files.delete(n)
        gone = [s for s in self.files.folders("segments") if s not in used]
        for s in gone:
            self.files.remove("segments", s)
        return len(gone)

    # --- reading ---

    def live(self) -> DataFrame:
        """(key, segment, block, doc) of each document's newest version."""
        rows = self._all("rows")
        if len(self.segments) > 1:
            rows = rows.groupBy(*self.key).agg(F.max(F.struct("segment", "block", "doc", "gone")).alias("_l")).select(*self.key, "_l.*")
        return rows.where("not gone").select(*self.key, "segment", "block", "doc")

    def _matching(self, hits: DataFrame) -> DataFrame:
        """Postings of the words that match, each with its terms. Few words
        go into the scan's own filter, so other folders and row groups are
        not opened."""
        if hits.count() > LISTED:
            return grams.key_join(self._all("postings"), hits, "token")
        tokens = sorted({r[0] for r in hits.select("token").collect()})
        lists = None
        for age, name in enumerate(self.segments):
            files = skipping.files_with(self._part(name, "files"), "token", tokens) if tokens else []
            one = skipping.read_files(self.spark, POSTINGS, f"{self.files.root}/segments/{name}/postings", files)
            one = one.where(F.col("token").isin(tokens)).withColumn("segment", F.lit(age))
            lists = one if lists is None else lists.unionByName(one)
        return grams.key_join(lists, hits, "token")

    def search(self, queries: DataFrame, k: int = 5, stats: dict | None = None) -> DataFrame:
        """(query, pos, key, score, rank) as ``search.batch_search`` of the
        documents gives: of each query the ``k`` best, ties by key.

        The best weights alone tell what the documents of a block can reach;
        of each query the blocks that can reach most are scored first, and
        then those that can reach the k-th score so far. ``stats`` takes how
        many (query, block) there were and were read."""
        keys = list(self.key)
        kinds = "query string, pos int, " + ", ".join(f"{c} {t}" for c, t in self.key.items()) + ", score decimal(12,2), rank int"
        if not self.segments:
            return self.spark.createDataFrame([], kinds)
        listed = stored(query_words(queries), "query_terms")
        hits = stored(word_matches(self._all("words").select("token"), listed), "word_matches")
        points = lambda w: F.floor(w * F.col("m") / 100).cast("int")
        found = self._matching(hits)
        reach = found.groupBy("segment", "block", "term").agg(F.max(points(F.col("best"))).alias("points"))
        reach = grams.key_join(reach, listed.select("query", "term"), "term").groupBy("query", "segment", "block").agg(F.sum("points").alias("reach"))
        reach = stored(reach, "reach")
        live = stored(self.live(), "live")

        def scored(blocks: DataFrame) -> DataFrame:
            """Scores of the live documents of (query, segment, block)."""
            asked = stored(blocks.select("query", "segment", "block"), "blocks")
            some = asked.select("segment", "block").distinct()
            lists = found.join(some, ["segment", "block"], "left_semi")
            docs = lists.select("segment", "block", "term", "m", F.explode("docs").alias("d")).groupBy("segment", "block", "d.doc", "term").agg(F.max(points(F.col("d.w"))).alias("points"))
            docs = docs.join(live, ["segment", "block", "doc"])
            of = asked.join(listed.select("query", "term"), "query")
            return docs.join(of, ["segment", "block", "term"]).groupBy("query", *keys).agg(F.sum("points").alias("points"))

        first = top_per_key(reach, ["query"], [F.desc("reach"), F.col("segment"), F.col("block")], FIRST).drop("rank")
        begun = stored(scored(first), "first_scores")
        least = top_per_key(begun, ["query"], [F.desc("points"), *[F.col(c) for c in keys]], k).where(F.col("rank") == k).select("query", F.col("points").alias("least"))
        rest = reach.join(first.select("query", "segment", "block"), ["query", "segment", "block"], "left_anti").join(least, "query", "left")
        rest = stored(rest.where(F.col("least").isNull() | (F.col("reach") >= F.col("least"))), "rest")
        if stats is not None:
            stats["blocks"], stats["read"] = reach.count(), first.count() + rest.count()
        best = begun.unionByName(scored(rest)).withColumn("score", (F.col("points") / 100).cast("decimal(12,2)"))
        top = top_per_key(best, ["query"], [F.desc("score"), *[F.col(c) for c in keys]], k)
        return top.join(listed.select("query", "pos").distinct(), "query").select("query", "pos", *keys, "score", "rank")
