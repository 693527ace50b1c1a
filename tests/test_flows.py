"""Whole runs, state files, bundles and the store's recovery."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import text
from cairnspark.operators import analysis, bundles
from cairnspark.operators.store import SCHEMAS, Conflict, Store, inbound, inbound_by_name, of_kind
from cairnspark.plans.engine import Engine
from cairnspark.plans.flows import Flows, explicit_symbols, normalised_enrichment
from cairnspark.sources import state

FILES = {
    "shop/texts.py": '"""Texts."""\n\n\ndef build_text(order):\n    """Text of the message."""\n    return helper(order)\n\n\ndef helper(order):\n    """Helper."""\n    return str(order)\n\n\ndef send_mail(order):\n    """Отправка письма клиенту."""\n    raise NotImplementedError\n',
    "shop/orders.py": "from shop.texts import build_text\n\n\nclass Orders:\n    def place(self, order):\n        return build_text(order)\n",
}


@pytest.fixture
def flows(spark, tmp_path):
    root = tmp_path / "tree"
    for path, body in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), "p")
    return Flows(engine, str(root), f"file://{tmp_path}/runs")


REQUEST = {"title": "build text of the message", "description": "return the order's text", "constraints": ["keep helper"]}


def test_replay_and_generate(spark, tmp_path, flows):
    code = 'def build_text(order):\n    """Text of the message."""\n    return helper(order) + "!"'
    run = flows.replay(REQUEST, "shop.texts.build_text", code)
    assert run.bundle["merge_plan"] == {"status": "ready", "changed_files": ["shop/texts.py"]} and run.bundle["ok"]
    assert [s["step_name"] for s in run.bundle["steps"]] == ["index_build", "search_primary_target", "read_tree", "context_supporting_code", "reference_retrieval", "generation_replay", "apply_staging", "merge_dry_run"]
    assert [c["caller"] for c in run.bundle["apply_result"]["impact"]["callers"]] == ["shop.orders.Orders.place"]
    written = json.loads(next((tmp_path / "runs").glob("pipeline-*/pipeline_run_*.json")).read_text())
    assert written["run_id"] == run.run_id and (Path(flows.root) / "shop/texts.py").read_text() == FILES["shop/texts.py"]
    staged = [p for p in flows.engine.store._manifest()["symbols"] if p.startswith("p@")]
    assert len(staged) == 1 and flows.engine.store.read("symbols", staged[0]).where("qualname = 'shop.texts.build_text'").first()["source_code"].endswith('"!"')
    with pytest.raises(ValueError, match="shortlist"):
        flows.replay(REQUEST, "shop.texts.gone", code)

    seen = []

    def generator(request):
        seen.append(request)
        return json.dumps({"status": "ok", "code_artifact": {"code": 'def build_text(order):\n    """Text."""\n    return undefined_name(order)'}})

    def repairer(request):
        seen.append(request)
        return {"status": "ok", "code_artifact": {"code": code}}

    run = flows.generate(REQUEST, "shop.texts.build_text", generator, repairer)
    assert run.bundle["execution_summary"]["status"] == "ready_for_merge_review" and run.bundle["merge_plan"]["status"] == "ready"
    assert seen[0]["target"]["qualname"] == "shop.texts.build_text" and "shop.texts.helper" in {x["qualname"] for x in seen[0]["related_symbols"]}
    assert {d["code"] for d in seen[1]["diagnostics"]} == {"unknown_runtime_name"} and seen[1]["generated_code_artifact"]["code"].endswith("undefined_name(order)")
    assert run.bundle["metrics"]["request"]["chars"] == sum(v["chars"] for k, v in run.bundle["metrics"].items() if k not in ("request", "request_chars"))
    bad = flows.generate(REQUEST, "shop.texts.build_text", generator)
    assert bad.bundle["merge_plan"]["status"] == "blocked" and bad.bundle["issues"][0]["code"] == "unknown_runtime_name"
    again = flows.repair(REQUEST, "shop.texts.build_text", {"status": "ok", "code_artifact": {"code": "def build_text(order):\n    return 1 +"}}, repairer)
    assert again.bundle["ok"] and again.bundle["apply_result"]["errors"] == []
    with pytest.raises(ValueError, match="generator result"):
        flows.generate(REQUEST, "shop.texts.build_text", lambda r: {"status": "error", "message": "no"})
    found = explicit_symbols(flows.engine._rows("symbols"), ["helper", "shop.orders.Orders", "place"], ["shop.texts"]).collect()
    assert [(r["qualname"], r["reason"]) for r in found] == [("shop.texts.helper", "explicit_name_in_module"), ("shop.orders.Orders.place", "explicit_name_in_module"), ("shop.orders.Orders", "explicit_qualname")] or {r["qualname"] for r in found} == {"shop.texts.helper", "shop.orders.Orders.place", "shop.orders.Orders"}


def test_analyze(spark, flows):
    flows.engine.build(flows.root)
    plain = flows.analyze([REQUEST])
    assert plain["status"] == "needs_user_decision" and plain["recommended_target"] is None and "shop.texts.build_text" in plain["candidates"] and plain["request_quality"] == "unknown"

    def reranker(request):
        pick = next(c["candidate_id"] for c in request["cards"] if c["qualname"] == "shop.texts.build_text")
        return {"recommended_candidate_id": pick, "target_confidence": 0.9, "ranked_candidates": [{"candidate_id": pick}]}

    sure = flows.analyze([REQUEST], planner=lambda r: {"operation": {"value": "replace_symbol"}, "search_plan": {"search_queries": ["helper"]}}, reranker=reranker)
    assert (sure["status"], sure["recommended_target"], sure["candidates"], sure["request_quality"]) == ("analyzed", "shop.texts.build_text", ["shop.texts.build_text"], "processable")
    rows = state.latest_sessions(sure["sessions"]).collect()
    assert [(r["status"], r["recommended_target"]) for r in rows] == [("analyzed", "shop.texts.build_text")] and sure["sessions"].count() == 2
    anchor = flows.analyze([REQUEST], "insert_after_symbol", reranker=reranker)
    assert (anchor["recommended_target"], anchor["target_role"]) == ("shop.texts.send_mail", "anchor")
    stub = flows.analyze([{"title": "Реализовать send_mail: отправка письма клиенту, build_text"}], "insert_after_symbol", reranker=reranker)
    assert (stub["requested_operation"], stub["recommended_target"]) == ("replace_symbol", "shop.texts.send_mail")

    def broken(_):
        raise OSError("down")

    assert flows.analyze([REQUEST], planner=broken, reranker=broken)["warnings"] == ["analysis_llm_search_plan_failed", "analysis_llm_rerank_failed"]


def test_onboarding(spark, tmp_path, flows):
    projects = spark.createDataFrame([("other", "/o", "ready")], "project_id string, project_root string, status string")
    path = f"file://{tmp_path}/kb/knowledge.yaml"
    enrich = lambda r: {"modules": {"shop/texts.py": {"title": "Тексты"}, "gone": {}}, "symbols": {"shop.texts.helper": {"title": "H"}, "zz": {"title": "x"}}, "requirements": {"R1": {"title": "one"}}}
    registry, report = flows.onboard(projects, "p1", path, enrich)
    assert {r["project_id"]: r["status"] for r in registry.collect()} == {"other": "ready", "p1": "ready"}
    assert report["warnings"] == ["unknown module gone", "unknown symbol zz"] and (report["modules"], report["requirements"]) == (2, 1)
    found = state.read_yaml(spark, path)
    assert found["modules"]["shop.texts"]["title"] == "Тексты" and found["symbols"]["shop.texts.helper"]["title"] == "H" and found["symbols"]["shop.texts.build_text"]["description"] == "Text of the message."
    assert state.knowledge(spark, path).modules.count() == 2

    def broken(_):
        raise OSError("down")

    registry, report = flows.onboard(projects, "p1", path, broken)
    assert report["status"] == "failed" and registry.count() == 1 and flows.engine.store.read("symbols", "p").count() == 0
    payload, warnings = normalised_enrichment({"symbols": {"a": 1}}, spark.createDataFrame([], "qualname string, kind string, file_path string, module_name string"))
    assert payload["symbols"] == {} and warnings == []


def rows(spark, table, *values):
    return spark.createDataFrame(list(values), SCHEMAS[table])


def test_store_recovers_from_interrupted_writes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("files", rows(spark, "files", ("p", "a.py", "1", "a"), ("q", "b.py", "1", "b")))
    real = store.write
    calls = []

    def stops(table, df, projects=None):
        calls.append(table)
        if len(calls) == 2:
            raise OSError("lost")
        return real(table, df, projects)

    symbol = rows(spark, "symbols", ("p", "a.py", "a", "f", "a.f", "function", "a", 1, 2, "", "", 0))
    edge = rows(spark, "relations", ("p", "a.py", "a.f", "calls", "g", None, "index", "low", 0))
    store.write = stops
    with pytest.raises(OSError):
        store.replace_files("p", rows(spark, "files", ("p", "a.py", "2", "a")), symbol, edge)
    store.write = real
    # nothing of the change is seen, above all not the new hash, and the next write works
    assert store.known_files("p").first()["file_hash"] == "1" and store.read("symbols").count() == 0
    store.replace_files("p", rows(spark, "files", ("p", "a.py", "2", "a")), symbol, edge)
    assert store.known_files("p").first()["file_hash"] == "2" and store.read("symbols", "p").count() == 1 and store.read("files").count() == 2
    # the other project's folder was not written again
    assert store._manifest(1)["files"]["q"] == store._manifest()["files"]["q"]
    number = store._numbers()[-1]
    with pytest.raises(Conflict):
        store._commit(number - 1, {})
    before = store.read("files").count()
    assert store.vacuum(1) >= 2 and store.read("files").count() == before and store._numbers() == [number]
    assert store.delete_project("p")["symbols"] == 1 and store.read("files").count() == 1


def test_two_writers_do_not_lose_a_change(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")

    def slow():
        a.write("files", rows(spark, "files", ("p", "a.py", "1", "a")))
        b.write("files", rows(spark, "files", ("q", "b.py", "1", "b")))

    with pytest.raises(Conflict):
        a.change(slow)
    assert [r["project_root"] for r in a.read("files").collect()] == ["q"]


def test_lookups(spark):
    e = spark.createDataFrame([("s2", "calls", "f", "m.f"), ("s1", "calls", "f", "m.f"), ("s3", "calls", "f", None), ("s3", "imports", "z", None)], "source_qualname string, relation_kind string, target_ref string, target_qualname string")
    assert [r[0] for r in inbound(e, "m.f").collect()] == ["s1", "s2"] and [r[0] for r in inbound_by_name(e, "f").collect()] == ["s3"] and [r[0] for r in of_kind(e, "imports").collect()] == ["s3"]


def test_state_files(spark, tmp_path):
    @dataclasses.dataclass
    class Part:
        path: Path
        names: set

    path = f"file://{tmp_path}/a/b.json"
    state.write_json(spark, path, {"x": Part(Path("a/b"), {"k", "j"}), 1: (1, "é")})
    assert json.loads((tmp_path / "a/b.json").read_text()) == {"x": {"path": "a/b", "names": ["j", "k"]}, "1": [1, "é"]} and "é" in (tmp_path / "a/b.json").read_text()
    state.write_json(spark, path, [1])
    assert json.loads(state.read_text(spark, path)) == [1] and state.read_text(spark, path + "x") is None
    state.write_request(spark, f"file://{tmp_path}/r.yaml", {"title": "т", "notes": None}, "yaml")
    assert state.change_request(spark, f"file://{tmp_path}/r.yaml") == {"title": "т", "description": "", "constraints": [], "notes": []}
    (tmp_path / "lib.yaml").write_text("artifacts:\n  - artifact_id: r1\n    title: One\n  - bad\n")
    assert [r["title"] for r in state.reference_library(spark, f"file://{tmp_path}/lib.yaml").collect()] == ["One"]
    (tmp_path / "bad.yaml").write_text("a: [")
    assert state.read_yaml(spark, f"file://{tmp_path}/bad.yaml") == {} and state.knowledge(spark, f"file://{tmp_path}/none.yaml").symbols.count() == 0
    assert [state.cast_setting(v, t) for v, t in (("Yes", bool), ("7", int), ("x", int), ("1.5", float), ("[a, b]", list), ("t", str))] == [True, 7, "x", 1.5, ["a", "b"], "t"]
    assert state.new_id("run").startswith("run-") and len({state.new_id("x") for _ in range(50)}) == 50


def test_case_folding(spark):
    signs = [chr(c) for c in range(32, 0xD800)] + [chr(c) for c in range(0xF900, 0xFFFE)]
    words = ["Straße", "ﬁnal ﬂow ﬃ", "ΣΑΣ ς", "ſet", "ŉx", "Ёлка", "K Å", "Ⅷ ǰ ẞ"] + ["".join(signs[i : i + 500]) for i in range(0, len(signs), 500)]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.normalise("w")).collect()]
    java = lambda w: w.casefold().replace("ё", "е")
    assert got[:8] == [java(w) for w in words[:8]]
    whole = [(a, b) for w, g in zip(words, got, strict=True) for a, b in zip(java(w), g, strict=False) if a != b] if all(len(java(w)) == len(g) for w, g in zip(words, got, strict=True)) else None
    assert whole is not None and len(whole) <= 400  # signs that the two runtimes' Unicode tables know differently


def test_clients(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    from cairnspark.operators import services
    from cairnspark.sources import clients, documents

    class Server(BaseHTTPRequestHandler):
        batches = True
        seen = []

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Server.seen.append((self.path, self.headers.get("Authorization")))
            if self.path == "/api/embed" and not Server.batches:
                self.send_error(404)
                return
            replies = {"/api/embed": lambda: {"embeddings": [[len(t), 1] for t in body["input"]]}, "/api/embeddings": lambda: {"embedding": [len(body["prompt"]), 2]}, "/chat": lambda: {"message": {"content": 'so {"a": 1,}'}}}
            data = json.dumps(replies[self.path]()).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        embed = clients.HttpEmbedder(url, "m", 10)
        assert embed([]) == [] and embed(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]]
        Server.batches = False
        assert embed(["abc"]) == [[3.0, 2.0]]
        rows = documents.embedded(spark.createDataFrame([("x",), ("yy",)], "text string").coalesce(1), embed).collect()
        assert [list(r["embedding"]) for r in rows] == [[1.0, 2.0], [2.0, 2.0]]
        assert services.chat_json(clients.HttpChat(f"{url}/chat", "m", 10, key="k"), "s", "u", 10) == {"a": 1} and Server.seen[-1] == ("/chat", "Bearer k")
    finally:
        server.shutdown()
        server.server_close()


def test_apply_and_references(spark, tmp_path, flows):
    from cairnspark.operators import diff, workspace
    from cairnspark.operators.store import repeated_keys
    from cairnspark.sources import documents

    for d, files in (("w", {"a/x.py": "new", "same.py": "1"}), ("p", {"gone.py": "old", "same.py": "1"})):
        for path, body in files.items():
            (tmp_path / d / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / d / path).write_text(body)
    make = lambda *paths: spark.createDataFrame([(p,) for p in paths], "file_path string")
    actions = diff.apply_actions(make("a/x.py", "gone.py", "none.py"), make("a/x.py", "same.py"), make("gone.py", "same.py"))
    assert workspace.applied(spark, actions, f"file://{tmp_path}/w", f"file://{tmp_path}/p") == {"copied": 1, "deleted": 1}
    assert (tmp_path / "p/a/x.py").read_text() == "new" and not (tmp_path / "p/gone.py").exists()
    with pytest.raises(ValueError, match="unsafe"):
        workspace.applied(spark, diff.apply_actions(make("../x"), make("../x"), make()), "file:///w", "file:///p")
    arts = documents.manifest(spark, [{"artifact_id": "r1", "title": "One"}]).withColumn("source", F.lit('"""Doc."""'))
    engine = flows.engine
    assert engine.sync_references(arts) == {"reference_documents_count": 1, "reference_documents_changed": True}
    assert engine.sync_references(arts)["reference_documents_changed"] is False and engine.sync_references(arts, force=True)["reference_documents_changed"] is True
    assert engine.store.read("doc_vectors", "reference_library").count() == 1
    assert repeated_keys("files", rows(spark, "files", ("p", "a", "1", "m"), ("p", "a", "2", "m"))).count() == 1 and repeated_keys("relations", engine.store.read("relations")).count() == 0


def test_small_operators(spark):
    one = spark.range(1)
    objects = F.array(F.struct(F.lit(1).alias("a")), F.struct(F.lit(2).alias("a")), F.struct(F.lit(1).alias("a")))
    assert [r["a"] for r in one.select(bundles.distinct_objects(objects).alias("v")).first()["v"]] == [1, 2]
    tests = F.array(F.struct(F.lit("tests.t.test_go").alias("qualname"), F.lit("t.py").alias("file_path"), F.array(F.lit("Calls M.F")).alias("reasons")))
    got = one.select(*[analysis.has_tests(tests, F.lit(x)).alias(x.replace(".", "_")) for x in ("a.go", "m.f", "a.zzz")]).first()
    assert tuple(got) == (True, True, False)
    replies = spark.createDataFrame([(1, "{}", ["c1", "c9"], "c1", None), (2, "x", None, None, True)], "reply_id int, raw string, ranked array<string>, recommended_candidate_id string, recovered boolean")
    cards = spark.createDataFrame([(1, "c1"), (1, "c2")], "reply_id int, candidate_id string")
    found = {r["reply_id"]: r for r in analysis.reply_diagnostics(replies, cards).collect()}
    assert (found[1]["cards"], found[1]["strict"], found[1]["unknown_ids"], found[1]["recommended_known"]) == (2, True, ["c9"], True) and (found[2]["strict"], found[2]["ranked"], found[2]["recommended_known"]) == (False, 0, False)
    payload = analysis.related_payload(spark.createDataFrame([("q", "src")], "qualname string, source_code string")).first()
    assert len(payload) == 16 and (payload["qualname"], payload["source_excerpt"], payload["kind"], payload["parent_qualname"], payload["truncated"]) == ("q", "src", "", None, False)
