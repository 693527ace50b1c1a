"""Payloads made to fit as the loop over payloads does it; traversal of many
roots; sweeps of a folder."""

from __future__ import annotations

import random
import shutil

from cairnspark.operators import budget, graph, workspace
from cairnspark.operators.store import Store
from cairnspark.streaming import events


def loop(payload, steps, limit):
    """The steps one by one over a payload."""
    plain = []
    for s in steps:
        if isinstance(s, budget.Halve):
            plain.append((s.name, workspace.halve(s.list, s.least)))
        elif isinstance(s, budget.Drop):
            plain.append((s.name, workspace.drop_field(s.list, s.field)))
        elif isinstance(s, budget.Keep):
            plain.append((s.name, workspace.keep_fields(s.list, list(s.fields))))
        else:
            plain.append((s.name, lambda p, s=s: workspace.clipped(p, s.list, s.chars)))
    return workspace.within_budget(payload, workspace.json_size, limit, plain, soft=1e9)


STEPS = [
    budget.Halve("halve a", "a", 3), budget.Clip("clip a", "a", 9), budget.Drop("drop b.y", "b", "y"), budget.Halve("halve b", "b"),
    budget.Keep("keep a.x", "a", ("x",)), budget.Halve("halve a again", "a", 1),
]


def test_as_the_loop_does(spark):
    """All kinds of signs, empty and missing lists, empty items, limits from
    loose to hopeless."""
    r = random.Random(6)
    text = lambda: "".join(r.choice('abcд😀"\\\n\t\b\f\r\x01\x1f/ ') for _ in range(r.randint(0, 30)))
    item = lambda: {k: text() for k in ("x", "y", "z") if r.random() < 0.8}
    rows = [(i, [item() for _ in range(r.choice([0, 1, 2, 7, 20]))], [item() for _ in range(r.choice([0, 3, 9]))] if i % 11 else None, "s") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a array<map<string,string>>, b array<map<string,string>>, size string")
    for limit in (10, 80, 300, 700, 100_000):
        got = budget.reduced(df.drop("size"), budget.F.lit(len('{"a": [], "b": []}')), ["a", "b"], STEPS, limit, 1.5).collect()
        for row, (_, a, b, _) in zip(sorted(got, key=lambda x: x["id"]), rows, strict=True):
            want, log = loop({"a": a, "b": b or []}, STEPS, limit)
            assert {"a": row["a"], "b": row["b"]} == want and row["steps"] == log
            assert row["size"] == workspace.json_size(want) and row["fits"] == (row["size"] <= 1.5 * limit)


def test_conversations_as_requests(spark, sf):
    from cairnspark.plans import driver_queries as dq

    turns: dict = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["turn"], r["role"] or "", r["text"] or "")):
        turns.setdefault(r["conv_id"], []).append({"role": r["role"] or "", "text": r["text"] or ""})
    found = {r["conv_id"]: r for r in dq.QUERIES["budgeted_requests"](spark, sf).collect()}
    assert found.keys() == turns.keys() and any(r["steps"] for r in found.values())
    for c, own in turns.items():
        want, log = loop({"turns": own}, dq.REQUEST_STEPS, dq.REQUEST_CHARS)
        assert (found[c]["turns"], found[c]["size"], found[c]["steps"]) == (len(want["turns"]), workspace.json_size(want), ",".join(log))


def test_many_roots(spark):
    """More roots than one long has bits, cycles, hubs and nulls, against a
    walk from each root."""
    r = random.Random(2)
    edges = [(f"n{r.randint(0, 149)}", f"n{r.randint(0, 149)}") for _ in range(260)] + [(f"n{i}", "n7") for i in range(100)] + [(None, "n1"), ("n1", None)]
    roots = [f"n{i}" for i in range(150)]
    back: dict = {}
    for a, b in edges:
        if a and b:
            back.setdefault(b, set()).add(a)
    want = set()
    for root in roots:
        seen, level = {root: 0}, [root]
        for hop in range(1, 4):
            level = sorted({a for n in level for a in back.get(n, ())} - seen.keys())
            seen |= dict.fromkeys(level, hop)
        want |= {(root, n, h) for n, h in seen.items()}
    df = spark.createDataFrame(edges, "src string, dst string")
    start = spark.createDataFrame([(x, x) for x in roots] + [(None, "n1")], "root string, node string")
    got = graph.reach(df, start, 3).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert graph.reach(df, start.limit(0), 3).count() == 0


def test_sweeps(spark, tmp_path):
    """Files added, changed and deleted leave the tables of a fresh sweep; a
    sweep of an unchanged folder writes nothing."""
    root = tmp_path / "src" / "m"
    root.mkdir(parents=True)
    (root / "a.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return 1\n")
    (root / "b.py").write_text("class B:\n    pass\n")
    folder = str(tmp_path / "src")
    store = Store(spark, f"file://{tmp_path}/store")
    assert events.swept(spark, folder, store, "p") == {"new": 2}
    before = store._numbers()
    assert events.swept(spark, folder, store, "p") == {} and store._numbers() == before
    (root / "b.py").unlink()
    (root / "a.py").write_text("def f():\n    return 2\n")
    (root / "c.py").write_text("X = 1\n\n\ndef h():\n    pass\n")
    assert events.swept(spark, folder, store, "p") == {"new": 1, "changed": 1, "deleted": 1}
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    events.swept(spark, folder, fresh, "p")
    for table in ("files", "symbols", "relations"):
        assert sorted(map(str, store.read(table).collect())) == sorted(map(str, fresh.read(table).collect())), table
    shutil.rmtree(root)
    (tmp_path / "src" / "last.py").write_text("")
    (tmp_path / "src" / "one.py").write_text("y = 2\n")
    query = events.follow(spark, folder, store, "p", f"{tmp_path}/ck", "1 second")
    try:
        for _ in range(120):
            if {r["file_path"] for r in store.known_files("p").collect()} == {"one.py"}:
                break
            query.awaitTermination(1)
        assert {r["file_path"] for r in store.known_files("p").collect()} == {"one.py"} and query.exception() is None
    finally:
        query.stop()
