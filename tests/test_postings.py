"""The postings index against a scan of all texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from cairnspark.functions import text
from cairnspark.operators import search
from cairnspark.operators.manifests import Conflict
from cairnspark.operators.postings import Postings

TERM = re.compile(text.TERM_PATTERN)
WEIGHTS = {"title": 300, "body": 120}
def fields():
    return {f: F.col(f) for f in WEIGHTS}

SCHEMA = "path string, no int, title string, body string, block string"


def corpus(n: int, seed: int = 3, first: int = 0):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeklmnorst") for _ in range(r.randint(2, 7))) for _ in range(400)] + ["описание", "описания", "уведомления", "straße", "Ёлка"]
    pick = lambda most: " ".join(words[min(int(r.expovariate(0.02)), len(words) - 1)] for _ in range(r.randint(0, most)))
    return [(f"p{i % 7}", i, pick(4), r.choice([None, "", pick(60), pick(60)]), "b") for i in range(first, first + n)], words


@pytest.fixture(scope="module")
def docs():
    return corpus(700)


def index_of(spark, root) -> Postings:
    return Postings(spark, str(root), {"path": "string", "no": "int"}, WEIGHTS)


def queries(spark, words):
    asked = [" ".join(words[i : i + 3]) for i in range(0, 400, 40)] + ["описанием уведомлениями", "ёлка STRASSE", "zzzz", "", "  ", words[3], words[3]]
    return spark.createDataFrame([(q, i) for i, q in enumerate(asked)], "query string, pos int")


def rows(df):
    return sorted((r["query"], r["rank"], r["path"], r["no"], r["score"], r["pos"]) for r in df.collect())


def scanned(spark, data, asked, k):
    df = spark.createDataFrame(data, SCHEMA)
    return rows(search.batch_search(df, asked, fields(), WEIGHTS, ["path", "no"], k))


def test_as_a_scan_finds(spark, docs, tmp_path, monkeypatch):
    data, words = docs
    monkeypatch.setattr("cairnspark.operators.postings.BLOCK", 16)
    index, asked = index_of(spark, tmp_path), queries(spark, words)
    assert index.search(asked).collect() == []
    index.build(spark.createDataFrame(data, SCHEMA), fields())
    for k in (1, 5, 1000):
        stats: dict = {}
        assert rows(index.search(asked, k, stats)) == scanned(spark, data, asked, k)
        assert stats["read"] < stats["blocks"] if k == 1 else stats["read"] <= stats["blocks"]
    assert index.search(asked.limit(0)).count() == 0


def test_updates(spark, docs, tmp_path):
    """Changed, new and deleted documents, twice over, then compaction and
    vacuum: always as an index made anew. An update writes only its own
    documents' words."""
    data, words = docs
    index, asked = index_of(spark, tmp_path), queries(spark, words)
    index.build(spark.createDataFrame(data, SCHEMA), fields())
    changed = [(p, n, f"{words[1]} {words[2]}", b, x) for p, n, _, b, x in data[:7]]
    name = index.update(spark.createDataFrame(changed, SCHEMA), fields())
    own = {t for _, _, title, body, _ in changed for t in TERM.findall(f"{title} {body or ''}".casefold().replace("ё", "е"))}
    assert {r[0] for r in index._part(name, "words").collect()} == own and index._part(name, "rows").count() == 7
    now = {(d[0], d[1]): d for d in [*data, *changed]}
    assert rows(index.search(asked)) == scanned(spark, list(now.values()), asked, 5)
    new = corpus(20, 9, 5000)[0] + [("p0", 0, "back again " + words[3], None, "b")]
    gone = [*[(d[0], d[1]) for d in data[3:40]], ("never", 1), ("p0", 0)]
    index.update(spark.createDataFrame(new, SCHEMA), fields(), spark.createDataFrame(gone, "path string, no int"))
    now = {k: d for k, d in now.items() if k not in set(gone)} | {(d[0], d[1]): d for d in new}
    want = scanned(spark, list(now.values()), asked, 5)
    assert rows(index.search(asked)) == want and len(index.segments) == 3
    index.compact()
    assert rows(index.search(asked)) == want and len(index.segments) == 1
    assert index.compact() is None and index.vacuum() == 3 and rows(index.search(asked)) == want
    index.update(spark.createDataFrame([], SCHEMA), fields(), spark.createDataFrame(list(now), "path string, no int"))
    assert index.search(asked).count() == 0


def test_two_writers(spark, docs, tmp_path):
    """The second of two writers from one state is refused, and a write that
    stops before its manifest changes nothing."""
    data, words = docs
    one, two = index_of(spark, tmp_path), index_of(spark, tmp_path)
    one.build(spark.createDataFrame(data[:50], SCHEMA), fields())
    base, asked = one.files.newest(), queries(spark, words)
    before = rows(one.search(asked))
    two._write("half", spark.createDataFrame(data[50:60], SCHEMA), fields(), None)
    assert rows(one.search(asked)) == before
    two.files.commit(base, {"segments": [*two.segments, "half"]})
    with pytest.raises(Conflict):
        one.files.commit(base, {"segments": []})
    assert rows(one.search(asked)) == scanned(spark, data[:60], asked, 5)


def test_odd_documents(spark, tmp_path):
    """Repeated keys together, null keys left out, very long texts whole, one
    word in all documents, names of columns of the index's own."""
    data = [("a", 1, "alpha", None), ("a", 1, "beta", "gamma"), (None, 2, "alpha", None), ("b", 3, None, "x " * 200_000 + "omega"), ("c", 4, "", "")] + [("d", i, "alpha", "alpha") for i in range(10, 300)]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "path string, no int, title string, body string, token int, segment int")
    index = index_of(spark, tmp_path)
    index.build(df, fields())
    asked = spark.createDataFrame([("alpha beta gamma", 0), ("omega", 1)], "query string, pos int")
    got = [(r["query"], r["rank"], r["path"], r["no"], float(r["score"])) for r in index.search(asked, 2).orderBy("query", "rank").collect()]
    assert got == [("alpha beta gamma", 1, "a", 1, 7.2), ("alpha beta gamma", 2, "d", 10, 3.0), ("omega", 1, "b", 3, 1.2)]


def test_scan_in_small_steps(spark, docs, tmp_path, monkeypatch):
    """The scan works rows out in steps, forgets words, and takes rows of a
    repeated key as one; it finds what the index does. Where no key repeats,
    neither words nor the rows that match are shuffled."""
    data, words = docs
    data = [*data[:250], *[(p, n, "zusatz straße", b, x) for p, n, _, b, x in data[:9]], ("p9", 1, None, "описание ﬁnal Ёлка", "b")]
    df, asked = spark.createDataFrame(data, SCHEMA), queries(spark, words)
    index = index_of(spark, tmp_path)
    index.build(df, fields())
    want = rows(index.search(asked, 7))
    for cells, known, batch in ((1 << 21, 200_000, "10000"), (2_000, 3, "17")):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "WORDS_KNOWN", known)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = search.batch_search(df, asked, fields(), WEIGHTS, ["path", "no"], 7)
        assert sorted(set(rows(found))) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = search.batch_search(spark.createDataFrame(data[:60], SCHEMA), asked, fields(), WEIGHTS, ["path", "no"], 7)
    moved = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert moved and not [x for x in moved if "term#" in x or "token#" in x or "query#" in x]


def test_lists_are_shuffled_once(spark, docs, tmp_path, monkeypatch):
    """Lists are written from one shuffle of (word, document), without a
    join of the texts; rows with a null key are left out."""
    plans, write = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        plans[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    data = [*docs[0][:40], (None, 1, "nowhere", "nowhere", "b")]
    index = index_of(spark, tmp_path)
    index.build(spark.createDataFrame(data, SCHEMA), fields())
    assert plans["postings"].count("Exchange") == 1 and "Join" not in plans["postings"]
    assert index.search(spark.createDataFrame([("nowhere", 0)], "query string, pos int")).collect() == [] and index.live().count() == 40
