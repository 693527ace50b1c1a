"""Contracts, decisions, workspace edits and budgets."""

from __future__ import annotations

import difflib

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import contracts, decisions, validate, workspace
from cairnspark.sources import facts


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def val(one, **cols):
    return one.select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_contracts(spark):
    source = "from dataclasses import dataclass\n\n\n@dataclass\nclass D:\n    a: int\n    b: str = ''\n\n\nclass E:\n    def __init__(self, x: int, y=1, *, z):\n        self.x = x\n\n    def go(self):\n        return self.x.run()\n\n\nv = E(1, z=2)\nv.go()\n"
    f = facts.facts(spark.createDataFrame([("u", "a.py", source)], "unit string, file_path string, source string")).cache()
    surface = {r["type"]: [(x["field"], x["required"]) for x in r["fields"]] for r in contracts.model_surfaces(f).collect()}
    assert surface["D"] == [("a", True), ("b", False)] and sorted(surface["E"]) == [("x", True), ("y", False), ("z", True)]
    assert {r["path"] for r in contracts.call_paths(f).collect()} >= {"E", "v.go", "self.x.run"}
    members = spark.createDataFrame([("E", "go"), ("X", "run"), ("Y", "run")], "type string, member string")
    assert [(r["path"], r["type"]) for r in contracts.api_surface(f, members).collect()] == [("v.go", "E")]
    reads = spark.createDataFrame([("c", "p", "E", "x"), ("c", "p", "E", "nope")], "contract string, param string, item_type string, field string")
    assert contracts.attribute_needs(reads, contracts.class_fields(f)).first()["fields"] == ["x"]
    symbols = spark.createDataFrame([("m.E", "go", "method", 3), ("m.E", "_hid", "method", 4), ("m.E", "__init__", "method", 1)], "parent_qualname string, name string, kind string, start_line int")
    need = contracts.required_members(symbols, spark.createDataFrame([("m.E",)], "class_qualname string"))
    assert {(r["member"], r["required"]) for r in need.collect()} == {("go", True), ("__init__", True)}
    free = spark.createDataFrame([("send_mail", None), ("save", "to disk")], "name string, docstring string")
    assert [r["name"] for r in contracts.required_contracts(free, ["mail"], True).collect()] == ["send_mail"]
    assert contracts.required_contracts(free, ["mail"], False).count() == 0 and contracts.required_contracts(free.limit(1), ["zzz"], True).count() == 1
    rel = spark.createDataFrame([("a.py", "imports", "m.gone"), ("b.py", "imports", "m.here"), ("tests/t.py", "imports", "m.gone")], "file_path string, relation_kind string, target_qualname string")
    assert [(r["file_path"], r["names"]) for r in contracts.consumers(rel, "m", ["here"]).collect()] == [("a.py", ["gone"])]
    t = spark.createDataFrame([("q", "long", "xxxx", False), ("q", "short", "x", False), ("q", "mod", "", True)], "target string, qualname string, source_code string, is_module boolean")
    assert [r["qualname"] for r in contracts.selected_tests(t, 0).collect()] == ["short"]
    dup = spark.createDataFrame([("a", "n", 2), ("a", "n", 1), (None, "n", 3)], "qualname string, name string, ord int")
    assert sorted(r["ord"] for r in contracts.deduped_payloads(dup).collect()) == [1, 3]


def test_contract_text(one):
    got = val(one, e=contracts.excerpt(F.lit("import a\nx\nname()\nnames\ny\nz = name"), F.array(F.lit("name"))), i=contracts.item_type(F.lit("List[Order]")), n=contracts.item_type(F.lit("int")))
    assert got == {"e": "import a\n...\nname()\n...\nz = name", "i": "Order", "n": None}


def test_decisions(one):
    got = val(
        one, p=decisions.protective(F.lit(" – Не менять API")), q=decisions.protective(F.lit("Add x")), s=decisions.named_symbols(F.lit("call a.do_it and __x__ plain")), g=decisions.named_symbols(F.lit("keep do_it")),
        m=decisions.import_change(F.lit("Change the import")), u=decisions.ui_action(F.lit("the Button")), st=decisions.stub(F.lit("def f():\n    raise NotImplementedError")), s2=decisions.stub(F.lit("x = 1  # TODO: later\n    pass")), ns=decisions.stub(F.lit("def f():\n    return 1")),
        sc=decisions.insert_scope(F.lit("x"), F.lit("class_body")), k=decisions.expected_kind(F.lit(None).cast("string"), F.lit("property")), t=decisions.accepted_target(F.lit("a"), F.lit(0.7)), t0=decisions.accepted_target(F.lit("a"), F.lit(0.1)),
        b=decisions.generation_block(F.lit("insert_after_symbol"), F.lit("method"), F.lit(None).cast("string")), b2=decisions.generation_block(F.lit("insert_after_symbol"), F.lit("method"), F.lit("class_body")),
        r=decisions.manual_review(F.lit(True), F.lit(False), F.lit(False), F.lit("t"), F.array(F.lit("w")), ("w",)), r2=decisions.manual_review(F.lit(False), F.lit(False), F.lit(True), F.lit("t"), F.array(F.lit("w")), ("w",)),
        o=decisions.member_insert(F.lit("replace_symbol"), F.lit("class"), F.lit("method"), F.lit("add one")), f=decisions.failed_paths(F.lit('FAILED tests/a.py::t\n  File "b.py", line 1\nERROR tests/a.py - x')),
        x=decisions.failure_excerpt(F.lit("a\n\nb\nc"), 2), fl=decisions.flow_references(F.lit("run `a.b.c` then self.x.y and Svc.go or a.b")),
    )
    assert got == {
        "p": True, "q": False, "s": ["a.do_it", "do_it"], "g": [], "m": True, "u": True, "st": True, "s2": False, "ns": False, "sc": "class_body", "k": "method", "t": "a", "t0": None, "b": "ambiguous_insert_scope", "b2": None,
        "r": True, "r2": False, "o": "insert_after_symbol", "f": ["tests/a.py", "b.py"], "x": "a\nb", "fl": ["a.b.c", "Svc.go"],
    }


def test_decision_frames(spark):
    c = spark.createDataFrame([("q", "a", True, 0.5, 10.0, 0.1, 0), ("q", "b", True, 0.5, 10.0, 0.1, 1), ("q", "c", False, 9.0, 1.0, 1.0, 2)], "query string, qualname string, is_stub boolean, relevance double, score double, confidence double, pos int")
    assert decisions.best_stub(c, ["query"]).first()["qualname"] == "a"
    b = spark.createDataFrame([("r", True), ("r", None), ("s", True)], "run_id string, ok boolean")
    assert {r["run_id"]: r["gate"] for r in decisions.repair_gate(b, ["run_id"]).collect()} == {"r": "rejected", "s": "accepted"}
    plan = decisions.merge_plan(spark.createDataFrame([("ready_for_merge_review", ["a"]), ("ready_for_merge_review", []), ("verification_failed", ["a"])], "verdict string, changed_files array<string>"))
    assert [r["merge_status"] for r in plan.collect()] == ["ready", "nothing_to_merge", "blocked"]
    refs, names = spark.createDataFrame([("m.build_text",), ("m.zzz",)], "ref string"), spark.createDataFrame([("p.build_texts",), ("q.build_text",), ("r.other",)], "name string")
    assert [(r["ref"], r["suggestion"]) for r in decisions.close_names(refs, names).orderBy("ref", "rank").collect()] == [("m.build_text", "q.build_text"), ("m.build_text", "p.build_texts")]


def test_edits(spark, one):
    got = val(
        one, a=workspace.spliced(F.lit("1\n2\n3"), F.lit(2), F.lit(2), F.lit("x\ny")), b=workspace.spliced(F.lit("1\n2\n3"), F.lit(2), F.lit(2), F.lit("x"), after=True), c=workspace.spliced(F.lit("1"), F.lit(1), F.lit(1), F.lit("x")),
        d=workspace.imports_edited(F.lit('"""D."""\nimport os\nimport re\nx = 1'), F.array(F.lit("import json"), F.lit("import os")), F.array(F.lit("import re"))),
    )
    assert got == {"a": "1\nx\ny\n3", "b": "1\n2\nx\n3", "c": "x", "d": '"""D."""\nimport json\nimport os\nx = 1'}
    a = spark.createDataFrame([("f", bytearray(b"one\ntwo\n")), ("same", bytearray(b"x")), ("bin", bytearray(b"\xff\xfe"))], "file_path string, content binary")
    b = spark.createDataFrame([("f", bytearray(b"one\n2\n")), ("same", bytearray(b"x")), ("new", bytearray(b"n\n")), ("bin", bytearray(b"\xff"))], "file_path string, content binary")
    out = {r["file_path"]: r["diff"] for r in workspace.unified_diffs(a, b).collect()}
    assert set(out) == {"f", "new"} and out["f"] == "".join(difflib.unified_diff(["one\n", "two\n"], ["one\n", "2\n"], "a/f", "b/f"))
    t = spark.createDataFrame([("a.py",), ("a.py::t",), ("b.py",)], "target string")
    assert sorted(r["target"] for r in workspace.deduped_targets(t).collect()) == ["a.py::t", "b.py"]
    files, nodes = spark.createDataFrame([("tests/t.py",)], "file_path string"), spark.createDataFrame([("tests/t.py", "C::m")], "path string, node string")
    asked = spark.createDataFrame([("tests.t.C.m",), ("tests.t.gone",), ("tests.t",), ("no.such",)], "target string")
    found = {r["target"]: (r["path"], r["status"]) for r in workspace.resolved_targets(asked, files, nodes).collect()}
    assert found == {"tests.t.C.m": ("tests/t.py::C::m", "resolved"), "tests.t.gone": ("tests/t.py", "fallback_file"), "tests.t": ("tests/t.py", "resolved"), "no.such": (None, "unresolved")}
    now = spark.createDataFrame([("f", bytearray(b"x"), None)], "file_path string, content binary, modificationTime timestamp")
    base = {r["file_path"]: (r["exists"], r["size"]) for r in workspace.baseline(spark.createDataFrame([("f",), ("f",), ("g",)], "file_path string"), now).collect()}
    assert base == {"f": (True, 1), "g": (False, None)}


def test_budgets():
    payload = {"cards": [{"name": f"n{i}", "doc": "d" * 50, "members": list(range(8))} for i in range(8)]}
    steps = [("halve_members", workspace.halve_inner("cards", "members")), ("halve_cards", workspace.halve("cards", 2)), ("drop_doc", workspace.drop_field("cards", "doc"))]
    out, log = workspace.within_budget(payload, workspace.json_size, 120, steps)
    assert workspace.json_size(out) <= 120 and log == ["halve_members"] * 3 + ["halve_cards"] * 2 + ["drop_doc"]
    assert workspace.within_budget(payload, workspace.json_size, 10**6, steps)[1] == []
    with pytest.raises(ValueError):
        workspace.within_budget(payload, workspace.json_size, 3, steps)
    assert workspace.first_fitting([{"a": "x" * 9}, {"a": "x"}], workspace.json_size, 12) == {"a": "x"} and workspace.least_doc_chars(1000, 100, 0.5) == 500


def test_services(spark, tmp_path):
    from cairnspark.operators import services
    from cairnspark.operators.store import Store

    make = spark.createDataFrame
    projects = make([("a", "/r"), ("b", "/r"), ("c", "/s")], "project_id string, project_root string")
    every, rejected = services.registered(projects, make([("d", "/r"), ("e", "/t")], "project_id string, project_root string"))
    assert every.count() == 4 and [r["project_id"] for r in rejected.collect()] == ["d"]
    assert services.by_root(projects, "/s/").count() == 1
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("search_docs", make([("/s", "d1", "q", "f", "symbol", "", "t")], store.read("search_docs").schema))
    assert services.unregistered(projects, store, "a")[1]["warnings"] == ["root is shared; data kept"]
    rest, report = services.unregistered(projects, store, "c")
    assert rest.count() == 2 and report["deleted"]["search_docs"] == 1 and report["warnings"] == ["documents 1, vectors 0"]
    meta = make([('{"p": "x"}',), ('{"p": "y"}',), (None,)], "meta string")
    assert services.without_meta(meta, "p", "x").count() == 2
    blocks = make([("r", "generated_test", False), ("r", "production", True), ("s", "production", False), ("s", "generated_test", False)], "run_id string, block string, ok boolean")
    assert {r["run_id"]: r["generated_only"] for r in services.generated_only_failure(blocks, ["run_id"]).collect()} == {"r": True, "s": False}
    checks = services.checks_to_blocks(make([("r", "pytest", None, "x\n\ny")], "run_id string, name string, ok boolean, output string")).first()
    assert tuple(checks) == ("r", "production", False, "pytest_failed", "x\ny")
    p = make([("q", "import_change", 0.5, 0), ("q", "import_change", 0.9, 1), ("q", "import_change", 0.9, 2)], "query string, change_kind string, confidence double, pos int")
    assert services.import_change_candidate(p, ["query"]).first()["pos"] == 1


def test_service_columns(one):
    from cairnspark.operators import services

    none = F.array().cast("array<string>")
    got = val(
        one, h=services.appended(F.array(F.lit("a"), F.lit("b")), F.lit("a")), h2=services.appended(none, F.lit("x")), r=services.requirement_ids(F.array(F.lit("R1 "), F.lit("R2")), F.lit("R2, ,R3")),
        t=services.target_choice(F.lit(" "), F.lit(None).cast("string"), F.lit("x")), c=services.has_code(F.array(F.lit("w")), ("w", "v")), i=services.insufficient(F.lit("insufficient"), F.lit(""), none),
        g=services.generated_test_path(F.lit("tests/a/test_generated_x.py")), g2=services.generated_test_path(F.lit("src/test_generated_x.py")),
    )
    assert got == {"h": ["a", "b"], "h2": ["x"], "r": ["R1", "R2", "R3"], "t": "x", "c": True, "i": True, "g": True, "g2": False}


def test_cards_and_flows(spark):
    from cairnspark.operators import services

    rows = [("m.py", "m", "m", "m", "module", None, 1, "", ""), ("m.py", "m", "Form", "m.Form", "class", "m", 1, "", ""), ("m.py", "m", "setup_ui", "m.Form.setup_ui", "method", "m.Form", 2, "", "bar.addAction(save)"), ("m.py", "m", "save", "m.Form.save", "method", "m.Form", 5, "", ""), ("n.py", "n", "save", "n.save", "function", "n", 1, "", "")]
    symbols = spark.createDataFrame(rows, "file_path string, module_name string, name string, qualname string, kind string, parent_qualname string, start_line int, docstring string, source_code string")
    relations = spark.createDataFrame([("m.Form.save", "calls", "n.save", "save")], "source_qualname string, relation_kind string, target_qualname string, target_ref string")
    found = services.cards(spark.createDataFrame([("m.Form.save", 0), ("m.Form.setup_ui", 1), ("gone", 2)], "qualname string, pos int"), symbols, relations, 3).cache()
    by = {r["qualname"]: r for r in found.collect()}
    assert by["m.Form.save"]["members"] == ["setup_ui"] and by["m.Form.save"]["calls"] == ["n.save"] and by["gone"]["name"] is None and by["gone"]["id"] == "c3"
    ranked = services.prioritised(found, services.card_priority("Add a button next to save", ["setup_ui"], [])).collect()
    assert [(r["qualname"], r["priority"]) for r in ranked] == [("m.Form.setup_ui", 45 + 45 + 25), ("m.Form.save", 10 + 12), ("gone", 0)]
    hit, miss = services.mapped_ids(spark.createDataFrame([("c1", 1), ("c9", 2)], "id string, rank int"), found)
    assert hit.first()["qualname"] == "m.Form.save" and miss.first()["id"] == "c9" and services.mentioned(found, ["save"]).count() == 1
    steps = spark.createDataFrame([(1, "call `m.Form.save` and Form.setup_ui, `m.py`, `x.y.save` or Zed.nothing_like")], "step_id int, step string")
    out = {r["ref"]: (r["target"], r["reason"]) for r in services.flow_references(steps, symbols).collect()}
    assert out["m.Form.save"] == ("m.Form.save", "symbol") and out["Form.setup_ui"] == ("m.Form.setup_ui", "alias") and out["m.py"] == ("m", "file")
    assert out["x.y.save"][1] == "similar" and out["Zed.nothing_like"][1] == "missing"
    layers = spark.createDataFrame([("a", "m"), ("b", "m")], "layer string, module string")
    kept, odd = services.merged_layers(layers, spark.createDataFrame([("a", "n"), ("a", "zz")], "layer string, module string"), symbols.where("kind <> 'x'").select(F.col("module_name").alias("module")))
    assert [tuple(r) for r in kept.collect()] == [("a", "n"), ("b", "m")] and odd.first()["module"] == "zz"
    assert sorted(r["qualname"] for r in services.direct_children(symbols, "m.Form").collect()) == ["m.Form.save", "m.Form.setup_ui"]
    traced = services.traced(symbols.where("kind = 'method'"), spark.createDataFrame([("m.Form.save",)], "qualname string"), spark.createDataFrame([("m",)], "module string"))
    assert {r["qualname"]: (r["target"], r["how"]) for r in traced.collect()} == {"m.Form.save": ("m.Form.save", "symbol"), "m.Form.setup_ui": ("m", "module")}
    assert services.chat_json(lambda s, u: 'ok {"a": 1,}', "s", "u") == {"a": 1}
    with pytest.raises(ValueError):
        services.chat_json(lambda s, u: "no", "s", "u")
    with pytest.raises(ValueError):
        services.chat_json(lambda s, u: "{}", "s", "u", 1)


def test_self_calls_without_required_keywords(spark):
    body = "class A:\n    def f(self, a, *, key, opt=1):\n        return a\n\n    def g(self, *args, key):\n        return self\n\n    def run(self, **kw):\n        {}\n\n\ndef f(*, other):\n    return other\n"
    calls = {"bad": "self.f(1, opt=2)", "open": "self.g(1)", "good": "self.f(1, key=2)", "star": "self.f(1, **kw)"}
    rows = [(u, "after/a.py", body.format(c)) for u, c in calls.items()] + [(u, "before/a.py", "") for u in calls]
    f = facts.facts(spark.createDataFrame(rows, "unit string, file_path string, source string"))
    request = spark.createDataFrame([(u, "replace_symbol", "run", "A", "m.A.run", "", ["a.py"], "a.py") for u in calls], "unit string, operation string, target string, parent string, qualname string, text string, changed array<string>, target_file string")
    case = validate.case_of(request, f, spark.createDataFrame([], "module string, name string"))
    issues = validate.validated(case, codes=["self_method_call_missing_required_keyword_only_args"])
    assert {(r["unit"], r["symbol"], r["message"], r["severity"]) for r in issues.collect()} == {("bad", "A.f", "key", "error"), ("open", "A.g", "key", "error")}


UNITS = "unit string, file_path string, source string"
ASKED = "unit string, operation string, target string, parent string, qualname string, text string, changed array<string>, target_file string, contracts array<string>, removed_imports array<string>, code string"


def asked(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (11 - len(r))) for r in rows], ASKED)


def issues_of(spark, sources, request, codes):
    case = validate.case_of(request, facts.facts(spark.createDataFrame(sources, UNITS)), spark.createDataFrame([], "module string, name string"))
    return {(r["unit"], r["code"], r["symbol"], r["message"]) for r in validate.validated(case, codes=codes).collect()}


def test_rules_on_relevance(spark):
    after = "def old():\n    pass\n\n\ndef Fresh():\n    pass\n"
    sources = [(u, f"{v}/a.py", s) for u in "abcde" for v, s in (("before", "def old():\n    pass\n"), ("after", after if u in "ab" else "def old():\n    return 1\n"))]
    sources += [("a", "tests/t.py", "def test_x():\n    assert fresh"), ("b", "tests/t.py", "def test_x():\n    assert old()"), ("c", "tests/t.py", "def test_x():\n    assert OLD"), ("d", "tests/t.py", "def test_x():\n    assert 1"), ("e", "tests/t.py", "def (")]
    request = asked(spark, *[(u, "insert_after_symbol" if u in "ab" else "replace_symbol", "old", None, "m.old", "", ["a.py"], "a.py") for u in "abcde"])
    codes = ["generated_test_ast_parse_failed_for_relevance", "generated_test_not_relevant", "generated_test_does_not_reference_new_symbol", "generated_test_does_not_reference_target_symbol"]
    got = {(u, c) for u, c, *_ in issues_of(spark, sources, request, codes)}
    assert got == {("b", codes[2]), ("d", codes[1]), ("d", codes[3]), ("e", codes[0])}
    case = validate.case_of(request, facts.facts(spark.createDataFrame(sources, UNITS)), spark.createDataFrame([], "module string, name string"))
    verdicts = {r["unit"]: r["verdict"] for r in validate.report(validate.validated(case, codes=codes), request).collect()}
    assert verdicts == {"a": "ready_for_merge_review", "c": "ready_for_merge_review", **dict.fromkeys("bde", "generated_test_verification_failed")}


def test_rules_on_types_and_values(spark):
    model = "from dataclasses import dataclass, field\nfrom pathlib import Path\nfrom .x import y\n\n\n@dataclass\nclass M:\n    n: int\n    rate: float = 1.0\n    tags: list[str] = field(default_factory=list)\n    note: str = ''\n    root: Path = Path('.')\n    free: str | None = None\n\n\n"
    after = model + (
        "class Svc:\n    def __init__(self, m: M):\n        self.m = m\n\n    def go(self, d):\n        self.m.n\n        self.m.gone\n        self._m.n\n        self.m.root / 'a'\n        self.m.note / 'a'\n        self.m.n / 2\n"
        "        M(n='x', rate=1)\n        M(n=1, tags=d.get('t'), note=None, free=None)\n        M(n=True, tags=None if d else [])\n        M(n=1, tags='a')\n\n\n"
        "def load(path: Path, k: int = 0) -> M:\n    return M(n=1)\n\n\ndef as_dict(x) -> dict:\n    return load(x)\n\n\ndef use():\n    v = load('p', 3)\n    load(Path('q'), 'three')\n    v.n\n    v.zzz\n    return v\n"
    )
    sources = [("u", "before/a.py", model), ("u", "after/a.py", after)]
    request = asked(spark, ("u", "replace_symbol", "go", "Svc", "m.Svc.go", "load with 3", ["a.py"], "a.py", ["m.load"], ["from pathlib import Path", "from .x import y as z", "import os", "from pathlib import PurePath"], "class A:\n    def b(self): pass\n"))
    codes = [
        "unknown_injected_dependency_attribute", "incompatible_operator_for_visible_type", "model_constructor_field_type_mismatch", "model_constructor_default_field_overridden_with_none", "unresolved_remove_import_change",
        "contract_call_argument_type_mismatch", "contract_call_uses_unrequested_literal_arg", "dict_return_annotation_returns_contract_object", "unknown_contract_result_attribute", "replace_symbol_artifact_contains_extra_symbol_text",
    ]
    got = {(c, s, m) for _, c, s, m in issues_of(spark, sources, request, codes)}
    assert got == {
        (codes[0], "M.gone", ""), (codes[0], "Svc._m", ""), (codes[1], "M.note", "str"), (codes[2], "M.n", "str for int"), (codes[2], "M.tags", "str for list"), (codes[3], "M.tags", "list"),
        (codes[4], "m.Svc.go", "import os"), (codes[4], "m.Svc.go", "from pathlib import PurePath"), (codes[5], "load", "str for Path"), (codes[5], "load", "str for int"), (codes[6], "load", "p"), (codes[6], "load", "three"),
        (codes[7], "as_dict", "M of load"), (codes[8], "M.zzz", ""), (codes[9], "m.Svc.go", "A, b"),
    }


def test_rule_on_the_order_of_preserved_values(spark):
    before = "def f(o):\n    o.total = 1\n    o['k'] = 2\n    return {'t': o.total, 'k': o['k']}\n"
    late = "def f(o):\n    out = {'t': o.total}\n    o.total = 1\n    o['k'] = 2\n    send(o['k'])\n    return out\n"
    sources = [(u, f"{v}/a.py", s) for u in "xyz" for v, s in (("before", before), ("after", before if u == "z" else late))]
    request = asked(spark, *[(u, "replace_symbol", "f", None, "m.f", "keep the order" if u != "y" else "rework", ["a.py"], "a.py") for u in "xyz"])
    assert issues_of(spark, sources, request, ["preserved_assignment_used_before_assignment"]) == {("x", "preserved_assignment_used_before_assignment", "m.f", "o.total")}


def test_sources_are_spread(spark, monkeypatch):
    """However few files a table's sources lie in, they are read by many
    tasks, and give the same facts; equal texts are told apart by unit."""
    sources = [(f"u{i}", f"after/{i % 3}.py", f"x = {i % 4}\n" if i % 5 else "def (") for i in range(40)]
    rows = spark.createDataFrame(sources, UNITS).coalesce(1)
    whole = sorted(map(str, facts.facts(rows).collect()))
    monkeypatch.setattr(facts, "FILES_A_TASK", 10)
    monkeypatch.setattr(facts, "ROWS_AT_ONCE", 7)
    spread = facts.facts(rows)
    assert spread.rdd.getNumPartitions() == 4 and sorted(map(str, spread.collect())) == whole
    assert {r["unit"] for r in spread.collect()} == {u for u, _, _ in sources}


def test_types_once_for_all_rules(spark, monkeypatch):
    """The fixpoint over variables runs once, whichever rules ask for it."""
    asked = []
    monkeypatch.setattr(validate.dataflow, "variable_types", lambda f, work=validate.dataflow.variable_types: asked.append(1) or work(f))
    source = "def g(x: int):\n    return x\n\n\ndef use():\n    w = 'a'\n    g(w)\n"
    request = spark.createDataFrame([("u", "replace_symbol", "g", None, "m.g", "t", ["a.py"], "a.py")], "unit string, operation string, target string, parent string, qualname string, text string, changed array<string>, target_file string")
    case = validate.case_of(request, facts.facts(spark.createDataFrame([("u", "after/a.py", source)], UNITS)), spark.createDataFrame([], "module string, name string"))
    codes = ["model_constructor_field_type_mismatch", "contract_call_argument_type_mismatch"]
    assert [r["code"] for r in validate.validated(case, codes=codes).collect()] == codes[1:] and len(asked) == 1


def test_equal_sources_are_judged_once(spark, tmp_path, monkeypatch):
    """``rule_counts`` judges one of the parts whose sources are equal and
    counts all of them, rows of one key and rows without a key among them."""
    import duckdb

    from cairnspark.plans import driver_queries as dq
    from cairnspark.plans import rule_queries

    few = ["missing_docstring_after_replace", "unknown_runtime_name", "self_method_call_missing_required_keyword_only_args", "generated_test_import_points_to_missing_module"]
    cycle = 360_360  # every remainder that the conditions ask for comes again
    rows = [(i % 6 + cycle * copy, f"Brand#{i % 6}", "LARGE", i % 6 + 1, 945.0 + 2 * (i % 6)) for copy in range(40) for i in range(6)]
    rows += [(2, "Brand#13", "SMALL", 30, 999.0)] * 3 + [(None, "Brand#13", "LARGE", 30, 900.0), (None, "Brand#4", "LARGE", 30, 960.0)] * 2
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    judged = []
    monkeypatch.setattr(validate, "case_of", lambda request, *rest, work=validate.case_of: judged.append(request.count()) or work(request, *rest))
    monkeypatch.setattr(validate, "validated", lambda case, codes, work=validate.validated: work(case, codes=few))
    monkeypatch.setattr(rule_queries, "PARTS_A_TASK", 50)
    got = sorted(map(tuple, dq.QUERIES["rule_counts"](spark, str(tmp_path)).select("code", "units", "first_unit", "last_unit").collect()))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(f"select code, units, first_unit, last_unit from ({dq.SQL['rule_counts']}) where code in {tuple(few)}").fetchall()
    assert got == sorted(want) and judged == [9]


def test_content_key(spark):
    """Equal for files in another order; other for other texts, paths or requests."""
    files = [[("a", "x"), ("b", "y")], [("b", "y"), ("a", "x")], [("a", 'x"},{"file_path":"b'), ("b", "y")], [("a", "y"), ("b", "x")], [("ab", "x"), ("", "y")], [("a", "x")], []]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id int, files array<struct<file_path: string, source: string>>")
    keys = [r["k"] for r in rows.orderBy("id").select(validate.content_key(F.col("files")).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 6
    asked = rows.where("id = 0").select(validate.content_key(F.col("files"), F.lit("m.A").alias("q")).alias("a"), validate.content_key(F.col("files"), F.lit("m.B").alias("q")).alias("b")).first()
    assert len({asked["a"], asked["b"], keys[0]}) == 3
