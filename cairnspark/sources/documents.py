"""Semi-structured sources: JSON run bundles and registries, manifests,
change requests, model replies, embeddings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import missing_commas_added, plain_quotes, trailing_commas_gone

STEP = "struct<step_name:string,status:string,started_at:string,finished_at:string,duration_ms:bigint,summary:string>"
RUN_SCHEMA = f"run_id string, project string, ok boolean, target string, title string, total_tokens string, generated_tests bigint, steps array<{STEP}>"
REFERENCE_SCHEMA = "artifact_id string, language string, artifact_type string, usage_mode string, source_path string, title string, description string, keywords array<string>, snippet_start_line int, snippet_end_line int"


def runs(spark: SparkSession, pattern: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """Run bundles, newest path first; unreadable files are left out."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    return found.withColumn("path", F.input_file_name()).orderBy(F.desc("path"))


def newest_bundle(files: DataFrame, exact: str) -> DataFrame:
    """Per run the bundle of the exact name, else the newest. ``files``:
    run_id, path, modificationTime."""
    order = Window.partitionBy("run_id").orderBy(F.col("path").endswith(exact).desc(), F.desc("modificationTime"), "path")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sessions(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """State files, newest first; malformed ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern).orderBy(F.desc("created_at"))


def session_of_workspace(sessions_: DataFrame, workspace: str) -> DataFrame:
    hit = F.array_contains("workspace_ids", workspace) | (F.col("last_workspace_id") == workspace)
    return sessions_.where(hit).orderBy(F.desc("created_at")).limit(1)


def manifest(spark: SparkSession, artifacts: list[dict]) -> DataFrame:
    """Reference artefacts with their defaults."""
    names = [c.split()[0] for c in REFERENCE_SCHEMA.split(", ")]
    rows = spark.createDataFrame([tuple(a.get(n) for n in names) for a in artifacts], REFERENCE_SCHEMA)
    default = {"language": F.lit("python"), "artifact_type": F.lit("template"), "usage_mode": F.lit("adapt"), "title": F.col("artifact_id"), "description": F.lit(""), "keywords": F.array().cast("array<string>")}
    return rows.withColumns({k: F.coalesce(F.col(k), v) for k, v in default.items()})


def leading_docstring(text: Column) -> Column:
    """The docstring of a text that begins with one."""
    return F.trim(F.regexp_extract(text, r'(?s)\A\s*"""(.*?)"""', 1))


def reference_documents(artifacts: DataFrame) -> DataFrame:
    """Search documents of artefacts that carry their ``source`` text."""
    parts = F.array("title", "description", F.array_join("keywords", " "), leading_docstring(F.coalesce("source", F.lit(""))))
    text = F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n")
    return artifacts.select(F.concat(F.lit("reference::"), "artifact_id").alias("doc_id"), F.col("artifact_id").alias("qualname"), "title", text.alias("text"), "artifact_id", "artifact_type", "usage_mode")


def snippet(source: Column, start: Column, end: Column, most: int) -> Column:
    """Short texts whole; of longer ones the declared span, else the head."""
    lines = F.split(source, "\n")
    span = F.when(start.isNotNull() & end.isNotNull(), F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))).otherwise(F.slice(lines, 1, most))
    return F.array_join(F.when(F.size(lines) <= most, lines).otherwise(span), "\n")


def target_summary(name: Column, docstring: Column, title: Column, description: Column) -> Column:
    """What a reference search says of its target besides the request."""
    return F.array_join(F.filter(F.array(name, docstring, title, description), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), " ")


def query_text(title: Column, description: Column, constraints: Column) -> Column:
    """A change request as one query; null where nothing is said."""
    parts = F.filter(F.flatten(F.array(F.array(title, description), F.coalesce(constraints, F.array().cast("array<string>")))), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.nullif(F.array_join(F.transform(parts, lambda p: F.trim(p)), " "), F.lit(""))


def balanced_object(text: str) -> str | None:
    """The first complete {...}, braces inside strings aside."""
    start = text.find("{")
    depth, in_string, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif in_string:
            skip, in_string = c == "\\", c != '"'
        elif c == '"':
            in_string = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def recovered(text: str | None, late_fields: tuple[str, ...] = ()) -> str | None:
    """A reply's object as compact JSON, repaired where it can be: fences,
    quotes, missing and trailing commas, and an object closed before one of
    ``late_fields``. Null where nothing parses to an object."""
    body = re.sub(r"\A\s*```[a-zA-Z]*\s*|\s*```\s*\Z", "", text or "").translate(str.maketrans("“”’", "\"\"'"))
    tries = [body, balanced_object(body) or ""]
    if m := re.search(r"\{.*\}", body, re.S):
        tries.append(m[0])
    for name in late_fields:
        tries.append(re.sub(r"\}\s*,?\s*(?=\"" + re.escape(name) + r"\"\s*:)", ",", body))
    tries += [re.sub(r",\s*([}\]])", r"\1", t) for t in tries]
    tries += [re.sub(r'(["}\]0-9el])[ \t]*\n(\s*"[A-Za-z_]+"\s*:)', r"\1,\n\2", t) for t in tries]
    for t in tries:
        try:
            out = json.loads(t)
        except ValueError:
            continue
        if isinstance(out, dict):
            return json.dumps(out, ensure_ascii=False, separators=(",", ":"))
    return None


def replies(df: DataFrame, column: str = "raw", late_fields: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``json``: the reply's object or null, and ``needs_review``: true
    where none was found. Replies that parse as they stand never leave the
    JVM."""

    @F.pandas_udf("string")
    def repair(raw: pd.Series) -> pd.Series:
        return raw.map(lambda t: recovered(t, late_fields))

    straight = trailing_commas_gone(missing_commas_added(plain_quotes(F.col(column))))
    easy = F.when(F.col(column).startswith("{") & F.try_parse_json(column).isNotNull(), F.to_json(F.try_parse_json(column)))
    out = df.withColumn("json", F.coalesce(easy, repair(F.when(easy.isNull(), F.col(column)))))
    return out.withColumn("needs_review", F.col("json").isNull() & (straight.isNotNull() | F.col(column).isNull()))


Embedder = Callable[[list[str]], list[list[float]]]


def hashed_embedder(width: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed hashes of word trigrams."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                for i in range(max(1, len(w) - 2)):
                    h = int.from_bytes(hashlib.blake2b(w[i : i + 3].encode(), digest_size=8).digest(), "little")
                    v[h % width] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return embed


def embedded(docs: DataFrame, embedder: Embedder | None = None, text: str = "text", batch: int = 64) -> DataFrame:
    """Adds ``embedding``; the embedder is called with up to ``batch`` texts
    at a time, and with one at a time where a batch fails."""
    embed = embedder or hashed_embedder()

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                own = texts[at : at + batch]
                try:
                    found = embed(own)
                except Exception:  # noqa: BLE001  an endpoint without batches
                    found = [embed([t])[0] for t in own]
                out += found
            yield pd.Series(out)

    return docs.withColumn("embedding", run(text))
