"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import math
import re

import duckdb
import pytest

from cairnspark.functions import text
from cairnspark.plans import driver_queries as dq
from cairnspark.plans.registry import CASE_SQL, CASES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", [*sorted(dq.SQL), *sorted(CASES)])
def test_query(name, spark, sf, con):
    df = (dq.QUERIES.get(name) or CASES[name])(spark, sf)
    rel = con.sql(dq.SQL.get(name) or CASE_SQL[name])
    names, rows = table(df.columns, df.collect())
    want_names, want = table(rel.columns, rel.fetchall())
    assert names == want_names
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == pytest.approx(b, rel=1e-6) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_every_labelled_document_has_a_say(spark, sf, con):
    """Each (source, language) with a label has a verdict."""
    want = con.sql("select distinct source, lang from documents join labels using (doc_id)").fetchall()
    assert sorted((r["source"], r["lang"]) for r in dq.QUERIES["verdict_fold_all"](spark, sf).collect()) == sorted(want)


def test_white_space_of_whole_texts(spark, tmp_path):
    """White space after the 200th character is collapsed too."""
    docs = [(1, " a \n\t b " * 5000), (2, "x" * 300 + "  \n y "), (3, ""), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: (r["sha256"], r["size"]) for r in dq.QUERIES["collapsed_texts"](spark, str(tmp_path)).collect()}
    whole = {d: " ".join(t.split()) if t is not None else None for d, t in docs}
    assert out == {d: (hashlib.sha256(t.encode()).hexdigest(), len(t)) if t is not None else (None, None) for d, t in whole.items()}


def test_tokens_that_occur_once(spark, sf, con):
    """They are in ``text_tokens`` too."""
    words = {w for (t,) in con.sql("select text from documents").fetchall() for w in re.findall(text.TERM_PATTERN, t.lower().replace("ß", "ss"))}
    once = {r["token"] for r in dq.QUERIES["text_tokens"](spark, sf).where("n = 1").collect()}
    assert len(once) > 1000 and len(once & words) > 0.99 * len(once)
