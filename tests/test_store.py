"""The store: changes of their own size, lookups that open few files,
compaction beside readers, and writes that stop."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import store as stores
from cairnspark.operators.store import Conflict, Store


def symbols(spark, project, files, each=5, version=1):
    ids = spark.range(len(files) * each, numPartitions=4)
    path = F.element_at(F.array(*[F.lit(f) for f in files]), (F.floor(F.col("id") / each) + 1).cast("int"))
    name = F.concat(F.lit("f"), (F.col("id") % each).cast("string"))
    return ids.select(
        F.lit(project).alias("project_root"), path.alias("file_path"), F.lit("m").alias("module_name"), name.alias("name"), F.concat(path, F.lit("."), name).alias("qualname"), F.lit("function").alias("kind"),
        F.lit(None).cast("string").alias("parent_qualname"), F.lit(version).alias("start_line"), F.lit(9).alias("end_line"), F.lit("").alias("docstring"), F.sha2(F.col("id").cast("string"), 256).alias("source_code"), F.col("id").alias("ord"),
    )


def relations(spark, project, files, source="index"):
    rows = [(project, f, f"{f}.f0", "calls", "g", f"{f}.f1", source, "high", 0) for f in files]
    return spark.createDataFrame(rows, stores.SCHEMAS["relations"])


def listed(spark, project, files, hash_="1"):
    return spark.createDataFrame([(project, f, hash_, "m") for f in files], stores.SCHEMAS["files"])


def filled(spark, store, project, n, each=5):
    names = [f"{project}/d{i}.py" for i in range(n)]
    store.replace_files(project, listed(spark, project, names), symbols(spark, project, names, each), relations(spark, project, names))
    return names


def size(root) -> int:
    return sum(f.stat().st_size for f in Path(root).rglob("*") if f.is_file())


def change_one(spark, store, project, path):
    store.replace_files(project, listed(spark, project, [path], "2"), symbols(spark, project, [path], 3, 2), relations(spark, project, [path]).limit(0))


def test_a_change_is_of_its_own_size(spark, tmp_path):
    """One file changed in a project of 20 files and in one of 2,000."""
    grown = []
    for n in (20, 2000):
        root = tmp_path / str(n)
        store = Store(spark, f"file://{root}")
        names = filled(spark, store, "p", n)
        before = size(root)
        change_one(spark, store, "p", names[7])
        grown.append(size(root) - before)
        got = store.read("symbols", "p")
        assert got.count() == 5 * n - 2 and {r["start_line"] for r in got.where(F.col("file_path") == names[7]).collect()} == {2}
        assert store.read("relations", "p").count() == n - 1 and store.known_files("p").where("file_hash = '2'").count() == 1
    assert grown[1] < 1.2 * grown[0]


def test_changes_upon_changes(spark, tmp_path):
    """Files changed again, deleted and brought back, other sources' relations
    left alone; the same after compaction, whose old parts a reader still has."""
    store = Store(spark, f"file://{tmp_path}")
    names, others = filled(spark, store, "p", 6), filled(spark, store, "q", 3)
    store.replace_source("p", "knowledge", relations(spark, "p", names[:2], "knowledge"))
    change_one(spark, store, "p", names[0])
    change_one(spark, store, "p", names[0])
    store.delete_files(listed(spark, "p", names[1:3]))
    store.replace_files("p", listed(spark, "p", names[1:2], "3"), symbols(spark, "p", names[1:2], 1, 3), relations(spark, "p", names[1:2]))
    store.replace_source("p", "knowledge", relations(spark, "p", names[1:2], "knowledge"))

    def state(s):
        return {t: sorted(map(tuple, s.read(t).collect()), key=str) for t in stores.SCHEMAS}

    now = state(store)
    assert {r[1]: r[2] for r in now["files"]} == dict.fromkeys(names[3:] + others, "1") | {names[0]: "2", names[1]: "3"}
    assert sorted((r[1], r[7]) for r in now["symbols"] if r[0] == "p") == sorted([(names[0], 2)] * 3 + [(names[1], 3)] + [(f, 1) for f in names[3:] for _ in range(5)])
    assert sorted((r[1], r[6]) for r in now["relations"] if r[0] == "p") == sorted([(names[1], "index"), (names[1], "knowledge")] + [(f, "index") for f in names[3:]])
    reader = store.read("symbols")
    store.compact("p")
    assert state(store) == now and all(len(of["p"]) == 1 for t, of in store._manifest().items() if "p" in of)
    assert sorted(map(tuple, reader.collect()), key=str) == now["symbols"]
    before = store._numbers()
    store.compact("p")
    assert store._numbers() == before and store.vacuum(1) > 5 and state(store) == now


def test_many_parts_are_put_into_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_PARTS", 3)
    store = Store(spark, f"file://{tmp_path}")
    names = filled(spark, store, "p", 4)
    for name in names:
        change_one(spark, store, "p", name)
    assert len(store._manifest()["symbols"]["p"]) <= 3 and store.read("symbols", "p").count() == 12


def test_lookups_open_few_files(spark, tmp_path):
    """Of a hundred files and more; also after changes, and with none missed."""
    store = Store(spark, f"file://{tmp_path}")
    names = [f"d{i:03}.py" for i in range(300)]
    rows = symbols(spark, "p", names).repartition(120, "qualname")
    store.write("symbols", rows)
    assert len(store.read("symbols", "p").inputFiles()) >= 100
    for q in ("d007.py.f3", "d123.py.f0", "d299.py.f4"):
        found = store.lookup("symbols", "p", "qualname", [q])
        assert len(found.inputFiles()) <= 3 and [r["qualname"] for r in found.collect()] == [q]
    change_one(spark, store, "p", "d007.py")
    assert [r["start_line"] for r in store.lookup("symbols", "p", "qualname", ["d007.py.f1"]).collect()] == [2]
    assert store.lookup("symbols", "p", "qualname", ["d007.py.f3"]).count() == 0
    assert store.lookup("symbols", "p", "name", ["f4"]).count() == 299 and store.lookup("symbols", "p", "qualname", []).count() == 0
    assert store.lookup("symbols", "gone", "qualname", ["d123.py.f0"]).count() == 0


def test_a_write_that_stops_before_its_manifest(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}")
    names = filled(spark, store, "p", 3)
    real = store.files.commit

    def lost(base, content):
        raise OSError("lost")

    monkeypatch.setattr(store.files, "commit", lost)
    with pytest.raises(OSError):
        change_one(spark, store, "p", names[0])
    monkeypatch.setattr(store.files, "commit", real)
    assert store.read("symbols", "p").where("start_line = 2").count() == 0
    change_one(spark, store, "p", names[0])
    assert store.read("symbols", "p").count() == 13


def test_one_name_for_one_writer(spark, tmp_path):
    """Even where both have seen the same newest manifest."""
    a, b = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    b.files.newest = lambda: 0
    a._commit(0, {"files": {}})
    with pytest.raises(Conflict):
        b._commit(0, {})
    assert a._manifest() == {"files": {}} and not [f for f in (tmp_path / "manifests").iterdir() if f.name.startswith("_")]
