"""Operators over a small project of our own, against plain Python."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import scoring, text
from cairnspark.operators import diff, graph, knowledge, search, usage, validate
from cairnspark.operators.store import Store, import_roots, outbound, skipped_path
from cairnspark.sources import code, documents, facts
from cairnspark.streaming import events

FILES = {
    "shop/__init__.py": "\n",
    "shop/api/orders.py": '''"""Order endpoints."""
from shop.services.orders import OrderService


class OrderController:
    def __init__(self, service: OrderService):
        self.service = service

    def create(self, customer):
        """Create an order."""
        return self.service.place(customer)

    def audit(self):
        return self.service.store.list_all()
''',
    "shop/services/orders.py": '''import json
from ..storage import Store as Repo
from shop.services.texts import build_text


class OrderService:
    def __init__(self, store: Repo):
        self.store = store

    def place(self, customer):
        order = self.store.add(customer)
        self.check(order)
        if not order:
            raise ValueError("no order")
        return build_text(order)

    def check(self, order):
        local = Repo()
        local.ping()
        return json.dumps(order)
''',
    "shop/services/texts.py": '''"""Texts for customers."""


def build_text(order):
    """Text of the message."""
    return helper(order)


def helper(order):
    return str(order)


async def later():
    pass
''',
    "shop/storage.py": "class Store:\n    def add(self, c):\n        return c\n\n    def ping(self):\n        return 1\n",
    "tests/test_orders.py": '''from shop.services.orders import OrderService
from shop.storage import Store


def test_place():
    service = OrderService(Store())
    assert service.place("x")
''',
    "broken.py": "def (:\n",
    ".venv/skip.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for path, body in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(body)
    return str(base)


@pytest.fixture(scope="module")
def index(spark, root):
    found = code.facts(code.scan(spark, root)).cache()
    return code.symbols(found).cache(), code.relations(found).cache(), found


def edges(index):
    return {(r["source_qualname"], r["relation_kind"], r["target_ref"], r["target_qualname"], r["relation_confidence"]) for r in index[1].collect()}


def test_scan_and_symbols(spark, root, index):
    scan = {r["file_path"]: r["module_name"] for r in code.scan(spark, root).collect()}
    assert set(scan) == set(FILES) - {".venv/skip.py"} and scan["shop/__init__.py"] == "shop.__init__"
    names = {(r["qualname"], r["kind"]): r for r in index[0].collect()}
    assert ("shop.services.orders.OrderService.place", "method") in names and ("shop.services.texts.later", "function") not in names
    row = names["shop.services.texts.build_text", "function"]
    assert (row["start_line"], row["end_line"], row["docstring"], row["parent_qualname"]) == (4, 6, "Text of the message.", "shop.services.texts")
    assert [r["file_path"] for r in code.parse_errors(index[2]).collect()] == ["broken.py"]


def test_edges(index):
    e = edges(index)
    s = "shop.services.orders.OrderService"
    assert (f"{s}.place", "calls", "build_text", "shop.services.texts.build_text", "high") in e
    assert (f"{s}.place", "calls", "add", "shop.storage.Store.add", "high") in e
    assert (f"{s}.place", "calls", "check", f"{s}.check", "high") in e
    assert (f"{s}.place", "calls", "ValueError", None, "low") in e
    assert (f"{s}.check", "calls", "ping", "shop.storage.Store.ping", "medium") in e
    c = "shop.api.orders.OrderController"
    assert (f"{c}.create", "exposed_by_controller", "place", f"{s}.place", "high") in e
    assert (f"{c}.audit", "calls", "list_all", f"{s}.list_all", "high") in e  # the attribute's type, whatever stands between
    t = "tests.test_orders.test_place"
    assert (t, "calls", "place", f"{s}.place", "medium") in e and (t, "covered_by_test", "place", f"{s}.place", "medium") in e
    assert ("shop.services.orders", "imports", "Repo", "shop.storage.Store", "medium") in e


def test_graph(spark, index):
    symbols, relations, _ = index
    start = spark.createDataFrame([("shop.services.texts.build_text",) * 2], "root string, node string")
    hops = {r["caller"]: (r["hops"], r["is_test"]) for r in graph.impact(relations, start).collect()}
    assert hops == {"shop.services.orders.OrderService.place": (1, False), "shop.api.orders.OrderController.create": (2, False), "tests.test_orders.test_place": (2, True)}
    tests = graph.related_tests(relations, symbols, start)
    assert [(r["test"], r["hops"]) for r in tests.collect()] == [("tests.test_orders.test_place", 2)]
    assert [r["command"] for r in graph.test_commands(tests, symbols).collect()] == ["pytest tests/test_orders.py"]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "a")], "src string, dst string")
    one = spark.createDataFrame([("a", "a")], "root string, node string")
    assert {(r["node"], r["hops"]) for r in graph.reach(loop, one, 5).collect()} == {("a", 0), ("c", 1), ("b", 2)}
    target = spark.createDataFrame([("shop.services.orders.OrderService.place",)], "qualname string")
    pack = graph.context_pack(symbols, relations, target).collect()[0]
    assert [x["other"] for x in pack["neighbors"]] == ["shop.services.orders", "shop.services.orders.OrderService", "shop.services.orders.OrderService.__init__", "shop.services.orders.OrderService.check"]
    assert {x["other"] for x in pack["inbound"]} == {"shop.api.orders.OrderController.create", "tests.test_orders.test_place"}
    assert [x["test"] for x in pack["tests"]] == ["tests.test_orders.test_place"] and pack["high"] >= 4 and pack["low"] == 1
    assert "shop.storage.Store.add" in [x["symbol"] for x in pack["related"]]


def test_resolution_guard(spark):
    symbols = spark.createDataFrame([("a.f", "f"), ("b.g", "g"), ("c.g", "g")], "qualname string, name string")
    rows = spark.createDataFrame([("a.f", "x"), (None, "f"), (None, "g"), ("no.f", None)], "target_qualname string, target_ref string")
    assert sorted((str(r["resolved"]), r["how"]) for r in graph.resolved(rows, symbols).collect()) == [("None", "unresolved"), ("None", "unresolved"), ("a.f", "exact"), ("a.f", "short_name")]
    known = spark.createDataFrame([("a",), ("a.b",)], "m string")
    near = graph.longest_prefix(spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "q string"), "q", known, "m")
    assert {r["q"]: r["nearest"] for r in near.collect()} == {"a.b.c": "a.b", "a.x": "a", "z": None}
    step = graph.cascade(rows.select(F.col("target_ref").alias("r")), "r", [("one", spark.createDataFrame([("f", "F1")], "ref string, target string")), ("two", spark.createDataFrame([("f", "F2"), ("g", "G2")], "ref string, target string"))])
    assert sorted((str(r["r"]), str(r["target"]), str(r["step"])) for r in step.collect()) == [("None", "None", "None"), ("f", "F1", "one"), ("g", "G2", "two"), ("x", "None", "None")]


KNOWLEDGE = {
    "modules": {"shop.services.texts": {"title": "Тексты", "layer": "services"}, "shop.storage": {"description": "Хранилище"}},
    "symbols": {"shop.services.texts.build_text": {"title": "Сборка текста", "keywords": ["текст", "сообщение"], "requirements": ["R1"]}},
    "requirements": {"R1": {"title": "Уведомление", "linked_symbols": ["shop.services.texts.build_text", "shop.services.orders.OrderService.place"]}, "R2": {"linked_symbols": ["shop.services.texts.build_text"]}},
    "architecture": {"layers": {"storage": ["shop.storage"], "late": {"modules": ["shop.storage"]}}},
}


def test_knowledge(spark, index):
    k = knowledge.from_document(spark, KNOWLEDGE)
    links = [(r["qualname"].rsplit(".", 1)[-1], r["req_id"], r["ord"]) for r in knowledge.requirement_links(k.links).orderBy("qualname", "ord").collect()]
    assert links == [("place", "R1", 0), ("build_text", "R1", 0), ("build_text", "R2", 1)]
    assert {r["module"]: r["layer"] for r in knowledge.module_layers(k).collect()} == {"shop.services.texts": "services", "shop.storage": "late"}
    rel = {(r["source_qualname"], r["relation_kind"], r["target_ref"]) for r in knowledge.relations(k).collect()}
    assert ("R2", "implements_requirement", "shop.services.texts.build_text") in rel and ("shop.services.texts", "belongs_to_layer", "services") in rel
    docs = {r["qualname"]: r["text"] for r in knowledge.search_documents(index[0], k).collect()}
    assert "Сборка текста" in docs["shop.services.texts.build_text"] and "shop.services.texts" not in docs
    assert knowledge.from_document(spark, ["no mapping"]).links.count() == 0


def brute_stem(word):
    word = word.casefold().replace("ё", "е")
    return next((word[: -len(s)] for s in text.SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)


def test_text(spark):
    words = ["уведомлениями", "Тексты", "изменение", "straße", "ёлками", "дом", "а", "ПИСЬМО", "x_y", "назначать", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.stem("w")).collect()] == [brute_stem(w) for w in words]
    assert df.limit(1).select(text.query_terms(F.lit("Добавить тексты и Ёлки 42 в письмо"))).first()[0] == sorted({"тексты", "елки", "письмо", "текст", "письм"} | {brute_stem("елки")})
    row = df.limit(1).select(
        text.truncated(F.lit("x" * 50), 30).alias("a"), text.ellipsis(F.lit("abcdef"), 5).alias("b"), text.truncated(F.lit("x"), 0).alias("c"), text.slug(F.lit("A b/C")).alias("d"),
        text.identifier_tokens(F.lit("HTTPServer_v2 getURL")).alias("e"), text.duration_text(F.lit(12345)).alias("f"), text.duration_text(F.lit(125000)).alias("g"), text.safe_double(F.lit("x")).alias("h"),
        text.type_name(F.lit("'typing.List[int]'")).alias("i"), text.signature(F.lit("@deco\ndef f(a,\n      b):\n    pass")).alias("j"), text.truncated_source(F.lit("y" * 100), 60).alias("k"),
    ).first()
    assert row["a"] == "x" * 14 + "\n# ... truncated ..." and row["b"] == "ab..." and row["c"] == "x" and row["d"] == "a_b_c"
    assert (row["f"], row["g"], row["h"], row["i"], row["j"]) == ("12.3s", "2m 5s", 0.0, "list", "def f(a, b):")
    assert len(row["k"]) == 60 and row["k"].endswith("original_chars=100")


def test_lists(spark):
    row = spark.range(1).select(
        knowledge.merged_list(F.array(F.lit(" a "), F.lit("b")), F.array(F.lit("b "), F.lit(""), F.lit("c"))).alias("m"), knowledge.overlap(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("o"),
        documents.query_text(F.lit(" t"), F.lit(None), F.array(F.lit("c "), F.lit(" "))).alias("q"), knowledge.default_keywords(F.lit("do_it"), F.lit("m.Big_One")).alias("k"),
        diff.added_symbols(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("c"), F.lit("b")), F.lit("t")).alias("s"), documents.snippet(F.lit("1\n2\n3\n4"), F.lit(2), F.lit(3), 3).alias("n"),
    ).first()
    assert (row["m"], row["o"], row["q"], row["k"], row["s"], row["n"]) == (["a", "b", "c"], 1.0, "t c", ["do it", "Big One"], ["c", "b"], "2\n3")


def brute_score(row, terms):
    total, matched = 0, 0
    for t in terms:
        best = 0
        for f, w in scoring.FIELD_WEIGHTS.items():
            value = (row.get(f) or "").casefold().replace("ё", "е")
            tokens = set(__import__("re").findall(text.TERM_PATTERN, value))
            m = 100 if t in tokens else 75 if value and t in value else 55 if value and brute_stem(t) in value else 0
            best = max(best, w * m // 100)
        total += best
        matched += best > 0
    return total, matched


def test_symbol_search(spark, index):
    k = knowledge.from_document(spark, KNOWLEDGE)
    bundle = knowledge.bundled(index[0], k).cache()
    query = "изменить текст уведомления о заказе order"
    out = search.symbol_search(bundle, query, 50).collect()
    terms = bundle.limit(1).select(text.query_terms(F.lit(query))).first()[0]
    want = {}
    for r in bundle.where("kind <> 'module'").collect():
        row = r.asDict() | {"keywords": " ".join(r["keywords"]), "requirement_text": " ".join(" ".join((x["id"], x["title"], x["description"])) for x in r["requirements"])}
        points, matched = brute_score(row, terms)
        points += 80 if r["kind"] in ("function", "method") else 0
        points += {"services": 75, "storage": -35}.get(r["layer"], 0)
        points += 55 if r["symbol_title"] or r["symbol_description"] else 0
        points += (65 + (45 if r["requirement_rank"] == 0 else 0)) if r["requirements"] else 0
        points += 20 * min(matched, 5) if matched >= 2 else 0
        about = " ".join((r["name"], r["docstring"], r["symbol_title"], r["symbol_description"])).casefold()
        points += 200 if any(s in about for s in scoring.TEXT_SYMBOL_STEMS) else 0
        points += 140 if r["layer"] == "services" and r["name"].startswith("build_") else 0
        points -= 160 if r["name"].startswith("assign_") else 0
        if points > 0:
            want[r["qualname"]] = points / 100
    assert {r["qualname"]: r["score"] for r in out} == pytest.approx(want)
    assert [r["qualname"] for r in out] == sorted(want, key=lambda q: (-want[q], -min(1, round(0.12 + want[q] / 22, 2)), next(r["file_path"] for r in out if r["qualname"] == q), q))
    assert out[0]["qualname"] == "shop.services.texts.build_text" and out[0]["category"] in scoring.CATEGORY.values()
    assert search.symbol_search(bundle, query, 3, "insert_after_symbol").count() == 3


def test_search_helpers(spark):
    c = spark.createDataFrame([("a", 3.0, 0), ("b", 3.0, 1), ("a", 5.0, 1), ("b", 3.0, 0)], "qualname string, score double, query_pos int")
    best = search.union_best(c, "qualname", 5)
    assert [(r["qualname"], r["score"], r["query_pos"]) for r in best.collect()] == [("a", 5.0, 1), ("b", 3.0, 0)]
    names = spark.createDataFrame([("m.z", "z"), ("a", "a")], "qualname string, name string")
    assert {r["qualname"]: r["score"] for r in search.with_hints(best, names, ["z", "a"]).collect()} == {"a": 5.0, "b": 3.0, "m.z": 100.0}
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "qualname string, pos int")
    ranked = spark.createDataFrame([("c", 1), ("b", 2), ("c", 3)], "qualname string, rank int")
    assert [r["qualname"] for r in search.reordered(rows, ranked).collect()] == ["c", "b", "a"]
    assert [r["qualname"] for r in search.moved_first(rows, "c", 0.7).collect()] == ["c", "a", "b"] and [r["qualname"] for r in search.moved_first(rows, "c", 0.5).collect()] == ["a", "b", "c"]
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("y", [1.0, 1.0])], "key string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["key"], round(r["similarity"], 4)) for r in search.vector_topk(v, q, 5).orderBy("rank").collect()] == [("x", 1.0), ("y", round(1 / (2 - 0.5**0.5), 4))]
    docs = documents.reference_documents(documents.manifest(spark, [{"artifact_id": "r1", "description": "order sender", "usage_mode": "reuse"}, {"artifact_id": "r2"}]).withColumn("source", F.lit('"""Doc order."""\nx = 1')))
    assert [(r["artifact_id"], r["score"]) for r in search.reference_topk(docs, "order order sender").collect()] == [("r1", 4.7), ("r2", 3.0)]


def test_guard_and_sets(spark):
    make = spark.createDataFrame
    base = make([("a", True, "1"), ("b", True, "1"), ("c", False, None), ("d", True, "1")], "file_path string, exists boolean, sha256 string")
    now = make([("b", "2"), ("c", "1"), ("d", "1"), ("e", "1")], "file_path string, sha256 string")
    asked = make([("./a",), ("b",), ("c",), ("d",), ("e",), ("Skip.py",), ("x\\y",)], "file_path string")
    states = diff.base_guard(asked, base, now, make([("skip.PY",)], "file_path string"))
    assert {r["file_path"]: r["state"] for r in states.collect()} == {"a": "deleted_after_baseline", "b": "changed_after_baseline", "c": "created_after_baseline", "d": "ok", "e": "unprotected", "x/y": "unprotected"}
    assert tuple(diff.guard_verdict(states).first()) == ("blocked", 3, 2)
    assert diff.guard_verdict(states.where("state = 'unprotected'")).first()[0] == "skipped"
    st = diff.status(make([("a", "1"), ("b", "1"), ("c", "1")], "k string, v string"), make([("a", "1"), ("b", "2"), ("d", "1")], "k string, v string"), ["k"], "v")
    assert tuple(diff.build_report(st).first()) == (2, 1, 1)
    dup = make([(None, 1, "x"), (None, 2, "y"), ("k", 3, "z")], "k string, ord int, v string")
    assert {r["v"] for r in diff.first_wins(dup, ["k"], ["ord"]).collect()} == {"x", "z"}
    total = graph.running_total(make([(i, i % 3) for i in range(100)], "i int, n int"), "n", ["i"], 7)
    assert {r["i"]: r["running"] for r in total.collect()} == {i: sum(j % 3 for j in range(i + 1)) for i in range(100)}


def test_store(spark, tmp_path, index):
    store = Store(spark, f"file://{tmp_path}/store")
    symbols, relations, _ = index
    mark = F.lit("p").alias("project_root")
    files = symbols.select(mark, "file_path", F.lit("h1").alias("file_hash"), "module_name").distinct()
    store.replace_files("p", files, symbols.select(mark, "*"), relations.select(mark, "*"))
    n = store.read("symbols").count()
    assert n == symbols.count() and store.known_files("p").count() == files.count()
    k = knowledge.relations(knowledge.from_document(spark, KNOWLEDGE)).select(mark, F.lit("").alias("file_path"), "*", F.lit(0).cast("long").alias("ord"))
    store.replace_source("p", "knowledge", k.select(*[c.split()[0] for c in __import__("cairnspark.operators.store", fromlist=["SCHEMAS"]).SCHEMAS["relations"].split(", ")]))
    one = files.where("file_path = 'shop/storage.py'")
    store.delete_files(one.select("project_root", "file_path"))
    assert store.read("symbols").count() == n - 4 and store.read("relations").where("relation_source = 'knowledge'").count() == k.count()
    assert outbound(store.rows("relations", "p"), "shop.services.orders").first()["relation_kind"] == "contains"
    assert [r[0] for r in import_roots(store.rows("relations", "p")).collect()] == ["json", "shop"]
    counts = store.delete_project("p")
    assert counts["files"] == files.count() - 1 and counts["search_docs"] == 0 and store.read("symbols").count() == 0
    paths = spark.createDataFrame([("a/.git/x",), ("a/x.PNG",), ("a/x.py",)], "p string")
    assert [r[0] for r in paths.select(skipped_path(F.col("p"), (".git",), (), (".png",))).collect()] == [True, True, False]


def test_validators(spark):
    before = 'class A:\n    def keep(self):\n        """Doc."""\n        return {"k": 1}\n\n    def run(self, a, b=1):\n        """Doc."""\n        raise KeyError(a)\n\n\ndef f():\n    pass\n'
    after = 'import os\n\n\nclass A:\n    def run(self, a, b=1):\n        self.ghost()\n        self.x = undefined\n        return self.run()\n\n\ndef f():\n    pass\n\n\ndef f():\n    pass\n'
    test = 'from shop.missing import A\nfrom shop.storage import nothing\n\n\ndef test_it(mocker, strange):\n    a = A(1, zz=2)\n    assert True\n'
    rows = [("u1", "before/a.py", before), ("u1", "after/a.py", after), ("u1", "tests/t.py", test), ("u2", "after/a.py", "def ok():\n    return 1\n"), ("u2", "before/a.py", "def ok():\n    return 2\n"), ("u3", "after/a.py", "def (")]
    f = facts.facts(spark.createDataFrame(rows, "unit string, file_path string, source string")).cache()
    request = spark.createDataFrame(
        [("u1", "replace_symbol", "run", "A", "m.A.run", "change", ["a.py"], "a.py"), ("u2", "replace_symbol", "ok", None, "m.ok", "change", ["a.py"], "a.py"), ("u3", "replace_symbol", "ok", None, "m.ok", "", ["b.py"], "a.py")],
        "unit string, operation string, target string, parent string, qualname string, text string, changed array<string>, target_file string",
    )
    project = spark.createDataFrame([("shop.storage", "Store")], "module string, name string")
    case = validate.case_of(request, f, project)
    issues = validate.validated(case).cache()
    got = {(r["unit"], r["code"]) for r in issues.collect()}
    expected = {
        "duplicate_symbol_definition", "unknown_runtime_name", "unknown_self_method", "unknown_self_attribute_assignment", "missing_docstring_after_replace", "self_method_call_missing_required_args", "unused_import_change",
        "possible_existing_method_contract_lost", "generated_test_only_trivial_asserts", "generated_test_uses_mocker_fixture", "generated_test_uses_unapproved_external_pytest_fixture", "generated_test_import_points_to_missing_module",
        "generated_test_imports_missing_project_name", "generated_test_does_not_reference_target_name", "generated_test_instantiates_target_parent_class",
    }
    assert {c for u, c in got if u == "u1"} >= expected
    assert not [c for u, c in got if u == "u2"]
    assert {c for u, c in got if u == "u3"} >= {"patch_ast_parse_failed", "target_file_not_changed"}
    verdicts = {r["unit"]: (r["verdict"], r["warnings"] > 0) for r in validate.report(issues, request).collect()}
    assert verdicts == {"u1": ("verification_failed", True), "u2": ("ready_for_merge_review", False), "u3": ("verification_failed", False)}
    only = validate.report(issues.where("block = 'generated_test'"), request)
    assert {r["unit"]: r["verdict"] for r in only.collect()}["u1"] == "generated_test_verification_failed"
    assert validate.validated(case, codes=["artifact"]) is None and len(validate.RULES) > 45


def test_more_rules(spark):
    before = "x = 1\n"
    after = (
        "from dataclasses import dataclass\nfrom os import path\n\n\n@dataclass\nclass M:\n    a: int\n\n\nclass D:\n    def do(self):\n        pass\n\n\nclass S:\n    def __init__(self, d: D):\n        self.d = d\n\n"
        "    def go(self):\n        self.d.do()\n        self.d.gone()\n        D.do()\n\n\ndef f(a, b=1, *, k):\n    from os import path\n    m = M(1)\n    m.a\n    m.zzz\n    return path\n\n\ndef g():\n    f()\n    f(1, k=2)\n"
    )
    test = "def test_a():\n    c = C(p='x')\n    D.do()\n    assert c\n"
    f = facts.facts(spark.createDataFrame([("u", "before/a.py", before), ("u", "after/a.py", after + "\n\nclass C:\n    def __init__(self, p: Path):\n        self.p = p\n"), ("u", "tests/t.py", test)], "unit string, file_path string, source string"))
    request = spark.createDataFrame(
        [("u", "replace_symbol", "f", None, "m.f", "", ["a.py"], "a.py", ["lib.used", "lib.f"], "insert_after_symbol", "m.other", "t.py"), ("v", "replace_symbol", "f", None, "m.f", "", ["a.py"], "a.py", [], "replace_symbol", "m.f", "t.py")],
        "unit string, operation string, target string, parent string, qualname string, text string, changed array<string>, target_file string, contracts array<string>, expected_operation string, expected_qualname string, test_file string",
    )
    case = validate.case_of(request, f, spark.createDataFrame([("os", "path")], "module string, name string"))
    got = {(r["unit"], r["code"], r["symbol"]) for r in validate.validated(case, ("production", "artifact", "generated_test")).collect()}
    for code, symbol in {
        "unknown_model_attribute": "M.zzz", "unknown_injected_dependency_method": "D.gone", "required_contract_not_used": "lib.used", "contract_method_called_on_class_instead_of_instance": "D.do",
        "contract_call_missing_required_positional_args": "f", "contract_call_missing_required_keyword_only_args": "f", "duplicated_import_change_with_local_import": "path", "code_artifact_unexpected_operation": "replace_symbol",
        "code_artifact_unexpected_target": "m.f", "generated_test_calls_project_instance_method_on_class": "D.do", "generated_test_constructor_argument_type_mismatch": "C.p",
    }.items():
        assert ("u", code, symbol) in got, code
    assert {("v", "code_artifact_missing_code", "m.f"), ("v", "generated_test_file_missing", "t.py")} <= got
    assert ("u", "required_contract_not_used", "lib.f") not in got and ("u", "unknown_model_attribute", "M.a") not in got
    assert {r["code"] for r in validate.structural(f).collect()} == {"structural_review"}
    fix = spark.createDataFrame([("a", True, None, 0, "d"), ("b", True, "E", 0, "d"), ("c", False, None, 0, "d"), ("d", True, None, 1, "d"), ("e", True, None, 0, " ")], "unit string, applied boolean, error string, failed_blocks int, diff string")
    assert {r["unit"]: r["code"] for r in validate.repair_issues(fix).collect()} == {"b": "repair_candidate_apply_failed", "c": "repair_not_applied", "d": "repair_candidate_rejected", "e": "repair_intent"}


def test_replies_and_bundles(spark, tmp_path):
    raw = ['{"a": 1}', '```json\n{"a": [1, 2,],}\n```', 'text {"a": "}"} tail', '{"a": 1\n"b": 2}', "none", None, '{"a": 1}, "late": 2}', "“x”"]
    rows = documents.replies(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"), late_fields=("late",)).orderBy("i").collect()
    assert [json.loads(r["json"]) if r["json"] else None for r in rows] == [{"a": 1}, {"a": [1, 2]}, {"a": "}"}, {"a": 1, "b": 2}, None, None, {"a": 1}, None]
    assert documents.recovered('{"a": {"x": 1}}, "late": 2}', ("late",)) is not None
    run = {"run_id": "r1", "project": "p", "ok": True, "total_tokens": "12", "generated_tests": 1, "steps": [{"step_name": "s", "duration_ms": 5}, {"step_name": "t"}]}
    for name, body in (("pipeline-1", json.dumps(run)), ("pipeline-2", "{bad"), ("pipeline-3", json.dumps(run | {"run_id": "r3", "ok": None, "total_tokens": "x"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "pipeline_run_x.json").write_text(body)
    out = usage.runs_table(documents.runs(spark, f"file://{tmp_path}/pipeline-*/pipeline_run_*.json").where("run_id is not null")).collect()
    assert [(r["run_id"], r["status"], r["duration_ms"], r["total_tokens"], r["had_generated_tests"]) for r in out] == [("r3", "unknown", 5, 0, True), ("r1", "passed", 5, 12, True)]
    e = documents.embedded(spark.createDataFrame([("one two",), (None,)], "text string"), batch=1).collect()
    assert len(e[0]["embedding"]) == 64 and sum(map(abs, e[1]["embedding"])) <= 1


def test_streams(spark, sf, tmp_path, root):
    data = spark.read.parquet(f"{sf}/events.parquet")
    data.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, frame in (("w", events.windowed(events.stream(spark, f"{tmp_path}/in"), "1 day")), ("s", events.sessions(events.stream(spark, f"{tmp_path}/in"))), ("o", events.once(events.stream(spark, f"{tmp_path}/in"), ["user_id", "event_type"]))):
        q = frame.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0
    days = data.groupBy(F.to_date("ts")).count().count()
    assert 0 < spark.table("w").select("start").distinct().count() <= days
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # a second run finds nothing new
        events.index_changes(spark, root, store, "p", f"{tmp_path}/ck").awaitTermination(120)
    assert store.read("symbols").where("kind = 'class'").count() == 3 and len(store._versions("symbols")) == 1


def test_engine_front(spark, root, tmp_path):
    from cairnspark.plans.engine import Engine, Recorder

    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), "p", KNOWLEDGE)
    run = Recorder("r")
    first = engine.build(root, recorder=run)
    assert first["indexed"] == len(FILES) - 1 and first["documents_changed"] > 0
    again = engine.build(root)
    assert again == {"indexed": 0, "unchanged": len(FILES) - 1, "deleted": 0, "documents_changed": 0}
    assert [r["step_name"] for r in run.table(spark).collect()] == ["scan", "graph_indexing", "knowledge_relations", "search_documents"]
    assert engine.search("текст уведомления", 3).first()["qualname"] == "shop.services.texts.build_text"
    assert engine.context(["shop.services.orders.OrderService.place"]).count() == 1
    assert engine.impact("shop.services.texts.build_text").count() == 3
    with pytest.raises(ZeroDivisionError):
        run.step("bad", lambda: 1 // 0)
    assert run.rows[-1][2] == "failed"
