"""Folding, stems and durations against Python's own."""

from __future__ import annotations

from cairnspark.functions import text


def test_durations_are_those_of_the_double(spark):
    """Every whole millisecond under a minute and some beyond, and negative ones."""

    def plain(ms: int) -> str:
        s = ms / 1000
        return f"{s:.1f}s" if s < 60 else f"{int(s // 60)}m {int(s % 60)}s"

    rows = spark.range(-2000, 62000).select("id", text.duration_text("id").alias("t")).collect()
    assert [r for r in rows if r["t"] != plain(r["id"])] == []


def test_every_sign_is_folded(spark):
    """But those that only one of the two libraries' tables knows."""
    signs = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0xFFFF)])]
    rows = spark.createDataFrame([(c, f"x{c}Y{c}") for c in signs], "c string, t string").select("c", text.normalise("t").alias("n")).collect()
    wrong = [r["c"] for r in rows if r["n"] != f"x{r['c']}Y{r['c']}".casefold().replace("ё", "е")]
    assert all(ord(c) > 0x1C80 for c in wrong) and len(wrong) <= 8
    assert {"ß", "ς", "ﬁ", "Ё", "İ"} & set(wrong) == set()


def test_stem_is_a_short_plan(spark):
    words = [root + s for root in ("слов", "сло", "word", "") for s in text.SUFFIXES] + ["", None]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem("w").alias("s"))
    assert len(df._jdf.queryExecution().toString()) < 20_000
    assert [r for r in df.collect() if r["s"] != (None if r["w"] is None else text.plain_stem(r["w"]))] == []
