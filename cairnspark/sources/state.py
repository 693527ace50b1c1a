"""Small state files: sessions, bundles, knowledge and requests as JSON or
YAML. They are written by the driver through the file system of the path, to a
name of their own that is then renamed, so a reader never sees half of one."""

from __future__ import annotations

import dataclasses
import json
import secrets
import uuid
from datetime import UTC, datetime
from pathlib import PurePath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = (
    "session_id string, project_id string, input_requirements string, requested_operation string, status string, created_at string, updated_at string, run_ids array<string>, "
    "workspace_ids array<string>, recommended_target string, selected_target string, analysis string"
)


def serialised(value: Any) -> Any:
    """Dataclasses as objects, paths as texts, tuples and sets as lists; sets
    in the order of their texts."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: serialised(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, PurePath):
        return str(value)
    if isinstance(value, dict):
        return {str(k): serialised(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return [serialised(v) for v in sorted(value, key=str)]
    if isinstance(value, (list, tuple)):
        return [serialised(v) for v in value]
    return value


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    fresh, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(fresh, p):  # some file systems do not rename over a file
        fs.delete(p, False)
        fs.rename(fresh, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text, null where there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def write_json(spark: SparkSession, path: str, payload: Any) -> None:
    write_text(spark, path, json.dumps(serialised(payload), ensure_ascii=False, indent=2))


def write_yaml(spark: SparkSession, path: str, payload: Any) -> None:
    import yaml

    write_text(spark, path, yaml.safe_dump(serialised(payload), allow_unicode=True, sort_keys=False))


def write_request(spark: SparkSession, path: str, payload: dict, kind: str = "json") -> None:
    (write_yaml if kind == "yaml" else write_json)(spark, path, payload)


def read_yaml(spark: SparkSession, path: str) -> Any:
    """A YAML (or JSON) file's content; an empty mapping where there is none
    or it does not parse."""
    import yaml

    try:
        return yaml.safe_load(read_text(spark, path) or "") or {}
    except yaml.YAMLError:
        return {}


def knowledge(spark: SparkSession, path: str):
    """The knowledge tables of a YAML file."""
    from ..operators.knowledge import from_document

    return from_document(spark, read_yaml(spark, path))


def reference_library(spark: SparkSession, path: str) -> DataFrame:
    """The artefacts that a YAML manifest lists under ``artifacts``."""
    from .documents import manifest

    found = read_yaml(spark, path)
    return manifest(spark, [a for a in (found.get("artifacts") if isinstance(found, dict) else found) or [] if isinstance(a, dict)])


def change_request(spark: SparkSession, path: str) -> dict:
    """A change request's file, JSON or YAML, with its defaults."""
    found = read_yaml(spark, path)
    found = found if isinstance(found, dict) else {}
    return {"title": "", "description": "", "constraints": [], "notes": []} | {k: v for k, v in found.items() if v is not None}


def rebuilt_knowledge(spark: SparkSession, path: str, symbols: DataFrame, enrichment: dict | None = None) -> dict[str, int]:
    """Rebuild a knowledge file over the indexed symbols: curated texts stay,
    new modules and symbols get defaults, names the index lacks go. Returns
    the counts."""
    old = read_yaml(spark, path)
    old = old if isinstance(old, dict) else {}
    part = lambda doc, k: doc.get(k) if isinstance(doc.get(k), dict) else {}
    more = enrichment or {}
    rows = symbols.select("qualname", "name", "kind", "module_name", "docstring").orderBy("qualname").toLocalIterator()
    modules: dict[str, dict] = {}
    named: dict[str, dict] = {}
    layer = lambda m: next((x for x in ("api", "services", "storage", "domain") if x in m.split(".")), None)
    for r in rows:
        target, kind = (modules, "modules") if r["kind"] == "module" else (named, "symbols")
        base = {"title": r["name"].replace("_", " ").strip(), "description": " ".join((r["docstring"] or "").split())}
        if r["kind"] == "module" and layer(r["qualname"]):
            base["layer"] = layer(r["qualname"])
        for source in (part(more, kind), part(old, kind)):
            base |= {k: v for k, v in (source.get(r["qualname"]) or {}).items() if v not in (None, "", [])}
        target[r["qualname"]] = base
    requirements = part(more, "requirements") | part(old, "requirements")
    write_yaml(spark, path, old | {"modules": modules, "symbols": named, "requirements": requirements, "architecture": part(old, "architecture") or part(more, "architecture")})
    return {"modules": len(modules), "symbols": len(named), "requirements": len(requirements)}


def new_id(prefix: str) -> str:
    return f"{prefix}-{datetime.now(UTC):%Y%m%dT%H%M%S%fZ}-{secrets.token_hex(3)}"


def cast_setting(value: str, kind: type) -> Any:
    """A setting's text as the type wanted; the text itself where it does not
    fit."""
    if kind is bool:
        return value.lower() in ("1", "true", "yes", "on")
    try:
        if kind is list:
            import yaml

            return yaml.safe_load(value)
        return kind(value) if kind in (int, float) else value
    except (ValueError, TypeError):
        return value


def new_session(spark: SparkSession, project_id: str, requirements: list[dict], operation: str = "replace_symbol") -> DataFrame:
    """The first row of a session."""
    now = datetime.now(UTC).isoformat()
    return spark.createDataFrame([(new_id("session"), project_id, json.dumps(requirements, ensure_ascii=False), operation, "created", now, now, [], [], None, None, None)], SESSION)


def analysed(sessions: DataFrame, session_id: str, target: str | None, operation: str | None = None, analysis: dict | None = None) -> DataFrame:
    """A session's next row: what an analysis recommends, and whether a user
    has to decide. Rows are appended; the newest of a session counts."""
    row = latest_sessions(sessions).where(F.col("session_id") == session_id)
    status = "needs_user_decision" if (analysis or {}).get("manual_review_required") else "analyzed"
    out = row.withColumn("recommended_target", F.lit(target).cast("string")).withColumn("status", F.lit(status)).withColumn("updated_at", F.lit(datetime.now(UTC).isoformat()))
    out = out.withColumn("requested_operation", F.lit(operation)) if operation else out
    return out.withColumn("analysis", F.lit(json.dumps(analysis, ensure_ascii=False))) if analysis else out


def latest_sessions(sessions: DataFrame) -> DataFrame:
    from ..operators.diff import latest

    return latest(sessions, ["session_id"], ["updated_at"])
