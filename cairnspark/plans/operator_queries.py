"""One query for each group of operators that no other query covers, over the
driver tables where they fit and over small fixed tables elsewhere, each beside
its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis, bundles, contracts, decisions, diff, graph, knowledge, search, services, store, usage, workspace
from ..sources import documents as sources
from .registry import Literal, case, query

Q = "'"


def any_sql(c: str, parts) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{p}')" for p in parts) + ")"


def in_sql(parts) -> str:
    return "(" + ", ".join(f"'{p}'" for p in parts) + ")"


def arr(*items: str):
    return list(items)


# --- decisions ------------------------------------------------------------------

REQUESTS = Literal(
    "id int, body string",
    (1, "Нужно реализовать метод build_text в shop.texts"), (2, "– Не менять API, оставить как есть"), (3, "  • keep the service as it is"), (4, "Заменить импорт json на orjson"),
    (5, "Исправить: установленный пакет не найден при запуске"), (6, "Добавить кнопку на панель инструментов"), (7, "Add a report summary per ticket, reuse the existing service"), (8, "do not duplicate helper code"),
    (9, "def f():\n    raise NotImplementedError"), (10, "x = 1  # TODO: later"), (11, "# todo: реализовать позже"), (12, "Свод по тикетам a_b.c_d и __init__"), (13, ""), (14, None), (15, "don't touch; never avoid this"),
).over("documents", "doc_id", body="v.body || ' ' || k.text")
_lower = "lower(coalesce(body, ''))"
_bare = "trim(lower(regexp_replace(coalesce(body, ''), '^[\\s\\-–—•]+', '')))"
_none = "[]::varchar[]"


@query(
    f"""select id, ({' or '.join(f"starts_with({_bare}, '{p}')" for p in decisions.PROTECTIVE)}) as protective,
    ({any_sql('body', decisions.IMPORTS)} and {any_sql('body', decisions.CHANGES)}) or ({any_sql('body', decisions.DEPENDENCIES)} and {any_sql('body', decisions.CONNECTIONS)} and {any_sql('body', decisions.REPAIRS)}) as import_change,
    {any_sql('body', decisions.IMPLEMENT)} as implementation, {any_sql('body', decisions.STUBS)} as stub, {any_sql('body', decisions.UI_ACTIONS)} as ui,
    ({any_sql('body', decisions.REUSE)} and {any_sql('body', decisions.EXISTING)}) or {any_sql('body', decisions.NO_DUPLICATES)} as reuse,
    array_to_string(list_sort(list_concat(case when {any_sql('body', decisions.SUMMARY_TOPIC[0])} then {list(decisions.SUMMARY_TOPIC[1])} else {_none} end, case when {any_sql('body', decisions.TICKET_TOPIC[0])} then {list(decisions.TICKET_TOPIC[1])} else {_none} end)), ',') as topics,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({_lower}, '[A-Za-zА-Яа-яЁё0-9_]+'), lambda w: length(w) >= 3 and w not in {in_sql(decisions.MEANINGLESS)}))), ',') as meaningful
    from {REQUESTS}"""
)
def request_classes(t):
    """The classifiers of requests and sources."""
    c = F.col("body")
    return REQUESTS.of(t).select(
        "id", decisions.protective(c).alias("protective"), decisions.import_change(c).alias("import_change"), decisions.implementation(c).alias("implementation"), decisions.stub(c).alias("stub"), decisions.ui_action(c).alias("ui"),
        decisions.reuse(c).alias("reuse"), F.array_join(decisions.topics(c), ",").alias("topics"), F.array_join(F.array_sort(decisions.meaningful(c)), ",").alias("meaningful"),
    )


_named = "list_filter(regexp_extract_all(coalesce(body, ''), '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda n: (contains(n, '_') or contains(n, '.')) and not regexp_matches(n, '^__.*__$'))"


@query(
    f"""with n as (select id, ({' or '.join(f"starts_with({_bare}, '{p}')" for p in decisions.PROTECTIVE)}) as guard, {_named} as names from {REQUESTS})
    select id, case when guard then '' else array_to_string(list_sort(list_distinct(list_concat(names, list_filter(list_transform(names, lambda n: string_split(n, '.')[-1]), lambda n: not regexp_matches(n, '^__.*__$'))))), ',') end as names from n"""
)
def request_names(t):
    """Symbols that a request names outright."""
    return REQUESTS.of(t).select("id", F.array_join(F.array_sort(decisions.named_symbols(F.col("body"))), ",").alias("names"))


STUBS = Literal(
    "query string, qualname string, name string, docstring string, title string, source string, kind string, score double, confidence double, pos int",
    ("реализовать отправку письма клиенту", "m.Mail.send", "send", "Отправка письма", "", "raise NotImplementedError", "method", 12.0, 0.5, 0),
    ("реализовать отправку письма клиенту", "m.Mail.log", "log", "Запись письма клиенту", "", "raise NotImplementedError()", "method", 12.0, 0.5, 1),
    ("реализовать отправку письма клиенту", "m.Mail", "Mail", "письма клиенту отправку", "", "NotImplementedError", "class", 90.0, 0.9, 2),
    ("реализовать отправку письма клиенту", "m.ready", "ready", "отправку письма клиенту", "", "return 1", "function", 50.0, 0.9, 3),
    ("build order total", "m.total", "total", "", "order total", "# todo: реализовать", "function", -3.0, 0.2, 0),
    ("build order total", "m.total2", "total", "", "order total", "# todo: реализовать", "function", -3.0, 0.2, 1),
    ("nothing alike", "m.z", "zzz", "", "", "NotImplementedError", "function", 99.0, 1.0, 0),
)
_bag = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[A-Za-zА-Яа-яЁё0-9_]+'), lambda w: length(w) >= 3 and w not in " + in_sql(decisions.MEANINGLESS) + "))"


@case(
    f"""with b as (select *, {_bag.format('query')} as qt, {_bag.format("concat_ws(' ', name, qualname, docstring, title, docstring)")} as ct from {STUBS}),
    r as (select *, case when least(len(qt), len(ct)) > 0 then len(list_intersect(qt, ct)) / least(len(qt), len(ct)) else 0 end as relevance from b),
    s as (select *, relevance + greatest(score, 0) / 100 + greatest(confidence, 0) / 10 as total from r where {any_sql('source', decisions.STUBS)} and relevance >= 0.12 and kind in ('method', 'function'))
    select query, qualname, round(relevance, 6) as relevance from s qualify row_number() over (partition by query order by total desc, pos) = 1"""
)
def stub_choice(t):
    rows = STUBS.df(t.spark)
    rows = rows.withColumn("is_stub", decisions.stub(F.col("source"))).withColumn("relevance", decisions.stub_relevance(F.col("query"), *[F.col(c) for c in ("name", "qualname", "docstring", "title", "docstring")]))
    return decisions.best_stub(rows, ["query"]).join(rows.select("query", "qualname", F.round("relevance", 6).alias("relevance")), ["query", "qualname"])


KEPT = Literal(
    "id int, operation string, recommended string, review boolean, codes array<string>, body string, kind string, is_stub boolean, relevance double",
    (1, "insert_after_symbol", "replace_symbol", False, [], "реализовать", "method", True, 0.5), (2, "insert_after_symbol", "replace_symbol", None, [], "реализовать", "function", True, 0.12), (3, "replace_symbol", "replace_symbol", False, [], "реализовать", "method", True, 0.5),
    (4, "insert_after_symbol", "insert_after_symbol", False, [], "реализовать", "method", True, 0.5), (5, "insert_after_symbol", "replace_symbol", True, [], "реализовать", "method", True, 0.5), (6, "insert_after_symbol", "replace_symbol", False, ["missing_stub_module"], "реализовать", "method", True, 0.5),
    (7, "insert_after_symbol", "replace_symbol", False, ["other"], "change", "method", True, 0.5), (8, "insert_after_symbol", "replace_symbol", False, [], "реализовать", "class", True, 0.5), (9, "insert_after_symbol", "replace_symbol", False, [], "реализовать", "method", False, 0.5),
    (10, "insert_after_symbol", "replace_symbol", False, [], "реализовать", "method", True, 0.1), (11, "insert_after_symbol", "replace_symbol", False, [], None, None, None, None),
).over("orders", "o_orderkey", relevance="case when v.relevance is not null then cast(k.o_orderkey % 25 as double) / 100 end")


@query(
    f"""select id, coalesce(operation = 'insert_after_symbol' and not coalesce(review, false) and not list_has_any(codes, {list(decisions.STUB_BLOCKERS)}) and {any_sql('body', decisions.IMPLEMENT)} and recommended = 'replace_symbol'
    and kind in ('method', 'function') and is_stub and relevance >= 0.12, false) as kept from {KEPT}"""
)
def stub_override(t):
    c = F.col
    return KEPT.of(t).select("id", decisions.stub_kept(c("operation"), c("recommended"), c("review"), c("codes"), c("body"), c("kind"), c("is_stub"), c("relevance")).alias("kept"))


CHOICES = Literal(
    "id int, scope1 string, scope2 string, kind1 string, kind2 string, target string, sure double, operation string, anchor_kind string, body string, reranked boolean, plan_review boolean, rerank_review boolean, codes array<string>",
    (1, "x", "class_body", "property", None, "m.a", 0.7, "insert_after_symbol", "method", "add one", True, False, False, []),
    (2, "module_body", "class_body", None, "class", "m.b", 0.65, "insert_after_symbol", "method", "нов метод", True, False, False, ["w"]),
    (3, None, None, "junk", "junk", " ", 0.9, "insert_after_symbol", "method", "", False, True, None, []),
    (4, None, "module_body", "method", "class", "m.c", 0.64, "replace_symbol", "class", "Добавить метод", False, False, True, ["w"]),
    (5, "", "", "function", None, None, None, "replace_symbol", "class", "rename", None, None, None, None),
    (6, "class_body", None, "method", None, "m.d", 1.0, "replace_symbol", "class", "new thing", True, None, True, None),
).over("orders", "o_orderkey", sure="case when v.sure is not null then cast(k.o_orderkey % 101 as double) / 100 end")
_scope = "coalesce(case when scope1 in ('module_body', 'class_body') then scope1 end, case when scope2 in ('module_body', 'class_body') then scope2 end)"
_kind = "coalesce({0})".format(", ".join(f"case when (case when k{i} = 'property' then 'method' else k{i} end) in ('class', 'function', 'method') then (case when k{i} = 'property' then 'method' else k{i} end) end" for i in (1, 2)).replace("k1", "kind1").replace("k2", "kind2"))
_target = "case when trim(coalesce(target, '')) <> '' and coalesce(sure, 0) >= 0.65 then target end"


@query(
    f"""select id, {_scope} as scope, {_kind} as kind, {_target} as target,
    case when operation = 'insert_after_symbol' and anchor_kind = 'method' and {_scope} is null then 'ambiguous_insert_scope' when operation = 'insert_after_symbol' and anchor_kind = 'method' and {_scope} = 'module_body' then 'unsafe_module_insert_after_method' end as block,
    case when operation = 'replace_symbol' and anchor_kind = 'class' and {_kind} = 'method' and {any_sql('body', ('add', 'new', 'добав', 'нов'))} then 'insert_after_symbol' else operation end as operation,
    case when coalesce(reranked, false) then coalesce(rerank_review, false) or list_has_any(coalesce(codes, {_none}), ['w']) or {_target} is null else coalesce(plan_review, false) or {_target} is null end as review from {CHOICES}"""
)
def target_choices(t):
    c = F.col
    scope, kind, target = decisions.insert_scope(c("scope1"), c("scope2")), decisions.expected_kind(c("kind1"), c("kind2")), decisions.accepted_target(c("target"), c("sure"))
    return CHOICES.of(t).select(
        "id", scope.alias("scope"), kind.alias("kind"), target.alias("target"), decisions.generation_block(c("operation"), c("anchor_kind"), scope).alias("block"),
        decisions.member_insert(c("operation"), c("anchor_kind"), kind, c("body")).alias("operation"), decisions.manual_review(c("reranked"), c("plan_review"), c("rerank_review"), target, c("codes"), ("w",)).alias("review"),
    )


@query(
    """with b as (select event_id // 7 as run, event_type in ('click', 'view') as production, value > 20 as ok from events)
    select run, count(*) filter (not coalesce(ok, false)) as failed, case when count(*) filter (not coalesce(ok, false)) = 0 then 'accepted' else 'rejected' end as gate,
    count(*) filter (not coalesce(ok, false) and not production) > 0 and count(*) filter (not coalesce(ok, false) and production) = 0 as generated_only, bool_and(coalesce(ok, false)) as all_ok from b group by 1"""
)
def repair_gates(t):
    """Blocks of checks folded to gates, over runs of seven events."""
    b = t("events").select(F.expr("event_id div 7").alias("run"), F.when(F.col("event_type").isin("click", "view"), "production").otherwise("generated_test").alias("block"), (F.col("value") > 20).alias("ok"))
    return decisions.repair_gate(b, ["run"]).join(services.generated_only_failure(b, ["run"]), "run").join(usage.all_ok(b, ["run"]).withColumnRenamed("ok", "all_ok"), "run")


# --- analysis -------------------------------------------------------------------

ANALYSES = Literal(
    "id int, status string, target string, sure double, review boolean, reranked boolean, plan_review boolean, codes array<string>, found array<string>, ranked array<string>, recommended string, alternatives array<string>",
    (1, "Uncertain", "m.a", 0.9, False, True, False, ["analysis_llm_plan_failed", "low_quality"], ["m.a", "m.b"], ["c1", " c2", ""], "c9", ["c3"]),
    (2, "insufficient", "m.a", 0.6, False, True, True, ["analysis_llm_rerank_json_recovered"], ["m.a"], [], "c2", ["c2", "c1", " "]),
    (3, "processable", " m.b ", 0.9, None, True, False, ["missing_stub_module"], ["m.b"], None, None, ["c1", "c2", "c3", "c4", "c5", "c6"]),
    (4, "unknown", None, None, True, False, False, [], [], None, "", None),
    (5, None, "m.z", 1.0, True, None, True, None, ["m.z"], ["a", "b", "c", "d", "e", "f"], None, None),
    (6, "unknown", "m.q", 0.65, False, False, False, ["missing_stub_module", "unsupported_new_file_required"], ["m.a"], None, "c1", None),
).over("orders", "o_orderkey", sure="case when v.sure is not null then cast(k.o_orderkey % 101 as double) / 100 end")
_acc = "case when not coalesce(review, false) and coalesce(sure, 0) >= 0.65 and list_contains(found, nullif(trim(target), '')) then nullif(trim(target), '') end"
_settled = "not coalesce(review, false) and target is not null and coalesce(sure, 0) >= 0.65"
_trimmed = "list_filter(list_transform(coalesce({0}, " + _none + "), lambda x: trim(x)), lambda x: coalesce(x, '') <> '')"
_ordered = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_alt = "list_filter(list_concat(case when coalesce(trim(recommended), '') <> '' then [trim(recommended)] else " + _none + " end, " + _trimmed.format("alternatives") + "), lambda x: true)"


@query(
    f"""select id, {_acc} as accepted, case when lower(trim(status)) in {in_sql(analysis.OPEN_STATES)} and not coalesce(review, false) and coalesce(trim(target), '') <> '' and coalesce(sure, 0) >= 0.65 then 'processable' else status end as quality,
    case when coalesce(reranked, false) then coalesce(review, false) or list_has_any(coalesce(codes, {_none}), {list(analysis.NEW_FILE_CODES)}) or {_acc} is null else coalesce(plan_review, false) or target is null end as needs_review,
    array_to_string(case when list_contains(codes, 'missing_stub_module') and not list_contains(codes, 'unsupported_new_file_required') then list_append(codes, 'unsupported_new_file_required') else coalesce(codes, {_none}) end, ',') as marked,
    array_to_string(case when {_settled} then list_filter(coalesce(codes, {_none}), lambda c: (starts_with(c, 'analysis_llm_') and ends_with(c, '_failed')) or c in {in_sql(analysis.KEPT_CODES)}) else coalesce(codes, {_none}) end, ',') as kept,
    array_to_string((case when len({_trimmed.format('ranked')}) > 0 then {_trimmed.format('ranked')} else {_ordered.format(_alt)} end)[1:5], ',') as items from {ANALYSES}"""
)
def analysis_outcomes(t):
    """What an analysis makes of a rerank: target, quality, review, warnings, ranked items."""
    c = F.col
    accepted = analysis.accepted(c("target"), c("sure"), c("review"), c("found"))
    join = lambda x: F.array_join(x, ",")
    return ANALYSES.of(t).select(
        "id", accepted.alias("accepted"), analysis.request_quality(c("status"), c("target"), c("sure"), c("review")).alias("quality"),
        analysis.review_required(c("reranked"), c("plan_review"), c("review"), c("codes"), accepted, c("target")).alias("needs_review"), join(analysis.new_file_marked(c("codes"))).alias("marked"),
        join(analysis.kept_warnings(c("codes"), c("review"), c("target"), c("sure"))).alias("kept"), join(analysis.ranked_items(c("ranked"), c("recommended"), c("alternatives"))).alias("items"),
    )


_cand = """select o_custkey as request, 'o' || o_orderkey as qualname, o_orderkey as pos, round(o_totalprice / 500000.0, 4) as confidence, case when o_custkey % 2 = 0 and o_orderpriority = '1-URGENT' then (o_orderkey % 3)::int end as llm_rank,
    case when o_custkey % 3 = 0 then 'o' || max(o_orderkey) over (partition by o_custkey) end as recommended, o_orderstatus = 'P' as named, case when o_custkey % 5 = 0 then 'insert_after_symbol' else 'replace_symbol' end as operation from orders"""


def _candidates(t):
    last = t("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("_last"))
    return t("orders").join(last, "o_custkey").selectExpr(
        "o_custkey as request", "concat('o', o_orderkey) as qualname", "o_orderkey as pos", "round(o_totalprice / 500000.0, 4) as confidence", "case when o_custkey % 2 = 0 and o_orderpriority = '1-URGENT' then cast(o_orderkey % 3 as int) end as llm_rank",
        "case when o_custkey % 3 = 0 then concat('o', _last) end as recommended", "o_orderstatus = 'P' as named", "case when o_custkey % 5 = 0 then 'insert_after_symbol' else 'replace_symbol' end as operation",
    )


@query(
    f"""with c as ({_cand}), a as (select *, bool_or(llm_rank is not null) over (partition by request) as any_ranked from c), r as (select * from a where not any_ranked or llm_rank is not null)
    select request, qualname, rank::int as rank from (select *, row_number() over (partition by request order by llm_rank nulls last, case when any_ranked then -confidence end, case when any_ranked then qualname end, case when qualname = recommended then 0 else 1 end, pos) as rank from r) where rank <= 5"""
)
def api_candidates(t):
    """Candidates of each request that the caller gets: orders by customer."""
    return analysis.returned_candidates(_candidates(t), ["request"]).select("request", "qualname", "rank")


@query(
    f"""with c as ({_cand}) select request, coalesce(string_agg(qualname, ',' order by pos) filter (named), '') as matches,
    case when count(*) filter (named) = 1 and max(operation) = 'replace_symbol' and max(recommended) is null then min(qualname) filter (named) end as fallback from c group by 1"""
)
def exact_match_diagnostics(t):
    return analysis.exact_matches(_candidates(t), ["request"]).select("request", F.array_join("matches", ",").alias("matches"), "fallback")


@query(
    f"""with c as ({_cand}), s as (select request, count(*) as candidates_count, string_agg(qualname, ',' order by pos) filter (n <= 3) as top_candidates from (select *, row_number() over (partition by request order by pos) as n from c) group by 1)
    select c_custkey as request, case when c_nationkey = 3 then 'needs_user_decision' else 'analyzed' end as status, coalesce(candidates_count, 0) as candidates_count, coalesce(top_candidates, '') as top_candidates from customer left join s on c_custkey = request"""
)
def analysis_summaries(t):
    analyses = t("customer").select(F.col("c_custkey").alias("request"), (F.col("c_nationkey") == 3).alias("review"))
    return analysis.summaries(analyses, _candidates(t), ["request"]).select("request", "status", "candidates_count", F.array_join("top_candidates", ",").alias("top_candidates"))


SYMBOLS = Literal(
    "file_path string, module_name string, qualname string, name string, kind string, parent_qualname string, start_line int, end_line int, source_code string, docstring string",
    ("a.py", "a", "a", "a", "module", None, 1, 40, "", None), ("a.py", "a", "a.F", "F", "class", "a", 3, 20, "class F: ...", "Form"), ("a.py", "a", "a.F.go", "go", "method", "a.F", 5, 9, "def go(self): button", None), ("a.py", "a", "a.F._hid", "_hid", "method", "a.F", 10, 12, "", None),
    ("a.py", "a", "a.F.__init__", "__init__", "method", "a.F", 4, 4, "", None), ("a.py", "a", "a.last", "last", "function", "a", 22, 30, "def last(): ...", "Last one"), ("a.py", "a", "a.inner", "inner", "function", "a.last", 23, 31, "", None), ("b.py", "b", "b.only", "only", "function", "b", 1, 3, "", None),
    ("b.py", "b", "b.G", "G", "class", "b", 1, 3, "", "Grid"), ("c/__init__.py", "c", "c", "c", "module", None, 1, 1, "", None), ("tests/test_a.py", "tests.test_a", "tests.test_a.test_go", "test_go", "function", "tests.test_a", 1, 5, "", None),
    ("c/d/x.py", "c.d.x", "c.d.x", "x", "module", None, 1, 9, "", "The x"), ("c/d/x.py", "c.d.x", "c.d.x.go", "go", "function", "c.d.x", 2, 3, "", None),
)
INSERTS = Literal(
    "id int, operation string, insert_scope string, target string",
    (1, "insert_after_symbol", None, "a.F"), (2, "insert_after_symbol", "class_body", "a.F.go"), (3, "insert_after_symbol", "module_body", "a.F.go"), (4, "replace_symbol", None, "a.F"), (5, "insert_after_symbol", None, "b.only"),
    (6, "insert_after_symbol", "class_body", "a.last"), (7, "insert_after_symbol", None, "gone"), (8, "insert_after_symbol", "module_body", "c.d.x.go"), (9, "insert_after_symbol", None, "tests.test_a.test_go"),
).over("orders", "o_orderkey")
_anchor = f"""m as (select file_path, min(qualname) as m from {SYMBOLS} where kind = 'module' group by 1),
    a as (select file_path, qualname as anchor, kind as anchor_kind from {SYMBOLS} left join m using (file_path) where kind in ('class', 'function') and (m is null or parent_qualname = m)
      qualify row_number() over (partition by file_path order by end_line desc, start_line desc, qualname desc) = 1)"""


@query(
    f"""with {_anchor}, s as (select qualname as q, kind as k, file_path from {SYMBOLS}), r as (select i.*, k, anchor, anchor_kind, coalesce(operation = 'insert_after_symbol' and not coalesce(insert_scope = 'class_body' and k in ('class', 'method'), false) and anchor is not null and anchor <> target, false) as moved
      from {INSERTS} i left join s on target = q left join a using (file_path)),
    p as (select *, coalesce(moved and k = 'method' and anchor_kind = 'class' and (insert_scope is null or insert_scope = 'module_body'), false) as parent from r)
    select id, case when moved then anchor else target end as final_target, case when parent then 'parent_class' when moved then 'anchor' else 'target' end as role, case when parent then 'class_body' else insert_scope end as scope from p"""
)
def insert_anchors(t):
    """Where insertions go."""
    return analysis.anchored(INSERTS.of(t), SYMBOLS.df(t.spark)).select("id", "final_target", "role", "scope")


REPLIES = Literal(
    "reply_id int, raw string",
    (1, 'oops {"recommended_candidate_id": "c2", "target_confidence": 0.8, "operation": "replace_symbol", "value": "class_body", "ranked": [{"candidate_id": "c1"}, {"candidate_id": "c9"}, {"candidate_id": "c2"}'),
    (2, '{"recommended_target": "m.\\"q\\"", "candidate_id": "zz"'), (3, "nothing"), (4, '"candidate_id":"c1" "candidate_id":"c1" "recommended_operation": "insert_after_symbol", "target_confidence": -1'), (5, ""),
)
CARDS = Literal("reply_id int, candidate_id string, qualname string", *[(i, f"c{k}", f"m.f{k}") for i in (1, 2, 3, 4) for k in (1, 2)])


@case(
    f"""with ids as (select r.reply_id, raw, list_concat(case when rec is not null then [rec] else {_none} end, regexp_extract_all(raw, '"candidate_id"\\s*:\\s*"([^"]+)"', 1)) as ids, rec from
      (select *, case when regexp_matches(raw, '"recommended_candidate_id"\\s*:\\s*"') then regexp_extract(raw, '"recommended_candidate_id"\\s*:\\s*"([^"]*)"', 1) end as rec from {REPLIES}) r),
    e as (select reply_id, c.candidate_id, qualname, min(place) as place from (select reply_id, unnest(ids) as candidate_id, generate_subscripts(ids, 1) as place from ids) i join {CARDS} c using (reply_id, candidate_id) group by 1, 2, 3),
    k as (select reply_id, string_agg(candidate_id, ',' order by place) filter (n <= 5) as ranked, arg_min(qualname, place) as first from (select *, row_number() over (partition by reply_id order by place) as n from e) group by 1)
    select ids.reply_id, coalesce(ranked, '') as ranked, coalesce(nullif(replace(regexp_extract(raw, '"recommended_target"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1), '\\"', '"'), ''), k.first) as recommended_target,
    coalesce(nullif(regexp_extract(raw, '"recommended_operation"\\s*:\\s*"([^"]*)"', 1), ''), nullif(regexp_extract(raw, '"operation"\\s*:\\s*"([^"]*)"', 1), ''), 'unknown') as operation, coalesce(nullif(regexp_extract(raw, '"value"\\s*:\\s*"([^"]*)"', 1), ''), 'unknown') as insert_scope,
    coalesce(nullif(regexp_extract(raw, '"target_confidence"\\s*:\\s*(-?[0-9]+([.][0-9]+)?)', 1), '')::double, 0) as target_confidence, true as manual_review_required
    from ids left join k using (reply_id) where ranked is not null or regexp_extract(raw, '"recommended_target"\\s*:\\s*"([^"]*)', 1) <> ''"""
)
def broken_reranks(t):
    """Fields of replies that no JSON parser takes."""
    found = analysis.recovered_reranks(REPLIES.df(t.spark), CARDS.df(t.spark))
    return found.select("reply_id", F.array_join("ranked", ",").alias("ranked"), "recommended_target", "operation", "insert_scope", "target_confidence", "manual_review_required")


@query(
    """select conv_id, count(*) as original_count, count(*) filter (role = 'user') as included_count, (count(*) filter (role <> 'user'))::int as dropped_count, coalesce(string_agg(turn::varchar, ',' order by turn) filter (role <> 'user'), '') as dropped from
    (select conv_id, turn, min(role) as role from conversations group by all) group by 1"""
)
def prompt_diagnostics(t):
    """Cards before and after a prompt was cut: the turns of conversations, users' kept."""
    turns = t("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    cards = turns.select("conv_id", F.col("turn").cast("string").alias("candidate_id"), F.col("turn").alias("pos"), "role")
    return analysis.prompt_diagnostics(cards.drop("role"), cards.where("role = 'user'").drop("role"), ["conv_id"]).select("conv_id", "original_count", "included_count", "dropped_count", F.array_join("dropped", ",").alias("dropped"))


EDGES = Literal("kind string, direction string, origin string, target string, module string", *[(k, d, o, "m.T", f"shop.{k}.{x}") for k, x in (("calls", "api"), ("imports", "storage"), ("exposed_by_controller", "x"), ("belongs_to_layer", "domain"), ("contains", "services")) for d in ("outbound", "inbound") for o in ("m.T", "m.T.go")], ("calls", "both", "m.T", "m.T", "services.api"))


@case(
    f"""select kind, direction, origin, module, case when kind = 'calls' and direction = 'outbound' then (case when origin <> target then 'called_by_class_member' else 'called_by_target' end) when kind = 'calls' and direction = 'inbound' then (case when origin <> target then 'caller_of_class_member' else 'caller_of_target' end)
    when kind = 'imports' then 'imported_contract' when kind = 'exposed_by_controller' then 'controller_or_endpoint_contract' when kind = 'belongs_to_layer' then 'same_layer_contract' else direction || '_' || kind end as role,
    case when list_contains(string_split(module, '.'), 'api') then 'api' when list_contains(string_split(module, '.'), 'services') then 'services' when list_contains(string_split(module, '.'), 'storage') then 'storage' when list_contains(string_split(module, '.'), 'domain') then 'domain' end as layer from {EDGES}"""
)
def relation_roles(t):
    c = F.col
    return EDGES.df(t.spark).select("kind", "direction", "origin", "module", analysis.relation_role(c("kind"), c("direction"), c("origin"), c("target")).alias("role"), analysis.layer_of(c("module")).alias("layer"))


_related = """select l_orderkey as root, case l_returnflag when 'A' then 'high' when 'N' then 'medium' else 'odd' end as relation_confidence, case l_linestatus when 'O' then 'outbound' else 'inbound' end as relation_direction,
    case l_linenumber % 3 when 0 then 'imports' when 1 then 'calls' else 'other' end as relation_kind, 'f' || (l_partkey % 7) as file_path, 's' || l_suppkey as origin_qualname, 'p' || l_partkey || '.' || l_linenumber as qualname, repeat('x', 10 + (l_partkey % 90)::int) as source_code from lineitem"""


@query(
    f"""with r as ({_related}), k as (select *, row_number() over (partition by root order by case relation_confidence when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 9 end, case relation_direction when 'outbound' then 0 else 1 end,
      case relation_kind when 'calls' then 0 when 'exposed_by_controller' then 1 when 'imports' then 2 when 'belongs_to_layer' then 3 else 9 end, file_path, origin_qualname, qualname) as rank from r),
    c as (select *, length(source_code) > 60 as truncated, case when length(source_code) <= 60 then source_code else left(source_code, greatest(0, 60 - length(chr(10) || '# ... truncated, original_chars=' || length(source_code)))::int) || chr(10) || '# ... truncated, original_chars=' || length(source_code) end as source_excerpt from k where rank <= 4)
    select root, qualname, rank::int as rank, truncated, source_excerpt, sum(length(source_excerpt)) over (partition by root order by rank)::bigint as total_chars from c"""
)
def related_selection(t):
    """The first related symbols of each target: the lines of orders."""
    rows = t("lineitem").selectExpr(
        "l_orderkey as root", "case l_returnflag when 'A' then 'high' when 'N' then 'medium' else 'odd' end as relation_confidence", "case l_linestatus when 'O' then 'outbound' else 'inbound' end as relation_direction",
        "case l_linenumber % 3 when 0 then 'imports' when 1 then 'calls' else 'other' end as relation_kind", "concat('f', l_partkey % 7) as file_path", "concat('s', l_suppkey) as origin_qualname", "concat('p', l_partkey, '.', l_linenumber) as qualname",
        "repeat('x', cast(10 + l_partkey % 90 as int)) as source_code",
    )
    return analysis.selected_related(rows, ["root"], 4, 60).select("root", "qualname", "rank", "truncated", "source_excerpt", F.col("total_chars").cast("long").alias("total_chars"))


NOTES = Literal("id int, title string, description string, ids array<string>, titles array<string>, raw_constraints array<string>, priority string", (1, " T ", "D", ["R1", "R2"], ["one", "two"], [" a ", "", "b"], "high"), (2, "", None, [], [], [], ""), (3, None, "only", ["R9"], ["nine"], [" "], None)).over("part", "p_partkey", title="case when v.title <> '' then v.title || k.p_name else v.title end", description="v.description || ' ' || k.p_type")


@query(
    f"""select id, array_to_string(list_concat(list_concat(case when coalesce(title, '') <> '' then ['Knowledge title: ' || title] else {_none} end, case when coalesce(description, '') <> '' then [description] else {_none} end),
      list_transform(ids, lambda x, i: 'Связано с требованием ' || x || ': ' || titles[i])), '|') as notes,
    trim(coalesce(title, '')) as clean_title, trim(coalesce(description, '')) as clean_description, array_to_string({_trimmed.format('raw_constraints')}, '|') as constraints, nullif(priority, '') as priority from {NOTES}"""
)
def notes_and_payloads(t):
    c = F.col
    reqs = F.transform(F.arrays_zip("ids", "titles"), lambda x: F.struct(x.ids.alias("id"), x.titles.alias("title")))
    one = analysis.requirement(c("title"), c("description"), c("raw_constraints"), F.lit(None).cast("string"), c("priority"))
    rows = NOTES.of(t).withColumn("p", one)
    return rows.select("id", F.array_join(analysis.annotations(c("title"), c("description"), reqs), "|").alias("notes"), c("p.title").alias("clean_title"), c("p.description").alias("clean_description"), F.array_join("p.constraints", "|").alias("constraints"), c("p.priority").alias("priority"))


PLANS = Literal(
    "id int, plan string",
    (1, '{"request_quality": {"status": "ok"}, "operation": {"value": "replace_symbol", "confidence": 0.5}, "search_plan": {"search_queries": ["a", "b", "c", "d"], "preferred_files": ["x.py"]}, "multi_target_likely": true, "junk": 1}'),
    (2, "{}"), (3, '{"search_plan": {"avoid_layers": ["api"]}, "expected_new_symbols": ["n"], "manual_review_required": true}'),
).over("orders", "o_orderkey", plan="replace(v.plan, 'replace_symbol', k.o_orderpriority)")


@query(
    f"""select id, json_extract_string(plan, '$.request_quality.status') as status, json_extract_string(plan, '$.operation.value') as operation, coalesce(array_to_string(from_json(json_extract(plan, '$.search_plan.search_queries'), '["VARCHAR"]')[1:3], ','), '') as queries,
    coalesce(array_to_string(from_json(json_extract(plan, '$.search_plan.avoid_layers'), '["VARCHAR"]'), ','), '') as avoid, coalesce(json_extract(plan, '$.multi_target_likely')::boolean, false) as multi, coalesce(json_extract(plan, '$.manual_review_required')::boolean, false) as review from {PLANS}"""
)
def search_plans(t):
    """Search plans cut to what a prompt needs."""
    p = PLANS.of(t).select("id", analysis.compact_plan(F.col("plan"), 3).alias("p"))
    return p.select("id", F.col("p.request_quality.status").alias("status"), F.col("p.operation.value").alias("operation"), F.array_join("p.search_plan.search_queries", ",").alias("queries"), F.array_join("p.search_plan.avoid_layers", ",").alias("avoid"), F.col("p.multi_target_likely").alias("multi"), F.col("p.manual_review_required").alias("review"))


# --- bundles --------------------------------------------------------------------

BUNDLES = Literal(
    "run_id string, workspace_path string, bundle string",
    ("r1", "/w/1", '{"merge_plan": {"changed_files": ["a.py", "/w/1/b.py", "x/__pycache__/c.pyc"], "excluded_files": ["Skip.py"]}, "apply_result": {"impact": {"changed_files": ["./a.py", "skip.PY"]}, "diff": {"changed_files": ["c.py", "/other/z.py"]}}}'),
    ("r2", "/w/2/", '{"merge_plan": {"changed_files": ["src/a.py", "tests/test_generated_a.py", "tests/test_b.py"]}, "generated_test_apply": {"verification_failed": true, "applied_tests": ["tests/test_generated_a.py"], "candidate_test_files": ["tests/test_generated_c.py"]}}'),
    ("r3", "/w/3", '{"merge_plan": {"changed_files": ["tests/test_generated_d.py", "e.py"]}, "execution_summary": {"status": "generated_test_verification_failed"}}'),
    ("r4", "/w/4", '{"merge_plan": {"changed_files": ["tests/test_generated_d.py"]}, "generated_test_apply": {"applied_tests": ["tests/test_generated_d.py"], "excluded_files": ["q.py", "Q.py"]}}'),
    ("r5", "/w/5", "{}"), ("r6", "/w/6", None),
)
_j = lambda path: f"coalesce(from_json(json_extract(bundle, '$.{path}'), '[\"VARCHAR\"]'), {_none})"
_flagged = lambda path: f"coalesce(json_extract(bundle, '$.{path}')::boolean, false)"
_changed3 = [_j("apply_result.impact.changed_files"), _j("apply_result.diff.changed_files"), _j("merge_plan.changed_files")]
_part = lambda i, e: f"list_transform({e}, lambda f: {{'p': {i}, 'f': f}})"
_concat = lambda xs: __import__("functools").reduce(lambda a, b: f"list_concat({a}, {b})", xs)
_rel = "regexp_replace(replace(trim({0}), '\\', '/'), '^(\\./)+', '')"
_clean = "case when not starts_with(f, '/') then f when starts_with(f, root || '/') then substring(f, length(root) + 2) else '' end"
_bundle_sql = f"""with b as (select *, regexp_replace(workspace_path, '/+$', '') as root, {_flagged('generated_test_apply.skipped')} or {_flagged('generated_test_apply.verification_failed')} or {_flagged('verification_report.summary.generated_test_failed')}
      or {_flagged('verification_report.summary.generated_test_runtime_only')} or coalesce(json_extract_string(bundle, '$.execution_summary.status'), '') = 'generated_test_verification_failed' as bad from {BUNDLES}),
    l as (select run_id, root, bad, {_concat([_part(i, _j(p)) for i, p in enumerate(("merge_plan.excluded_files", "generated_test_apply.excluded_files", "verification_report.summary.generated_test_excluded_files", "verification_report.summary.generated_test_failed_files", "generated_test_apply.candidate_test_files", "generated_test_apply.applied_tests"))] + [_part(6, c) for c in _changed3])} as x from b),
    e as (select run_id, place, p, {_clean} as file_path from (select run_id, root, place, p, {_rel.format('f')} as f from (select run_id, root, bad, generate_subscripts(x, 1) as place, unnest(x, recursive := true) from l) where p < 4 or bad)),
    ex as (select run_id, place, file_path from e where file_path <> '' and (p < 6 or regexp_matches(file_path, '^tests/(.*/)?test_generated_[^/]*\\.py$')) qualify row_number() over (partition by run_id, lower(file_path) order by place) = 1),
    cl as (select run_id, root, {_concat(_changed3)} as x from b), ce as (select run_id, place, {_clean} as file_path from (select run_id, root, place, {_rel.format('f')} as f from (select run_id, root, generate_subscripts(x, 1) as place, unnest(x) as f from cl))),
    ch as (select run_id, place, file_path from ce where file_path <> '' and not contains('/' || file_path, '/__pycache__/') and not ends_with(lower(file_path), '.pyc') and (run_id, lower(file_path)) not in (select (run_id, lower(file_path)) from ex) qualify row_number() over (partition by run_id, file_path order by place) = 1)
    """


@case(_bundle_sql + "select run_id, 'excluded' as list, string_agg(file_path, ',' order by place) as files from ex group by 1 union all select run_id, 'changed', string_agg(file_path, ',' order by place) from ch group by 1")
def bundle_files(t):
    """Files that runs changed and files that must not be copied."""
    b = BUNDLES.df(t.spark)
    pack = lambda df, name: df.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "file_path"))), lambda x: x.file_path), ",").alias("files")).select("run_id", F.lit(name).alias("list"), "files")
    return pack(bundles.excluded_files(b), "excluded").unionByName(pack(bundles.changed_files(b), "changed"))


SESSIONS = Literal("session_id string, project_id string, workspace_id string, last_workspace_id string, last_run_id string", ("s1", "p", "w1", "w1", "r1"), ("s2", "p", "w2", "w3", "r2"), ("s3", "q", "w5", None, "r5"))


@case(
    _bundle_sql + f"""select workspace_id, session_id, s.last_run_id as run_id, coalesce((select string_agg(file_path, ',' order by place) from ch where ch.run_id = s.last_run_id), '') as changed, coalesce((select string_agg(file_path, ',' order by place) from ex where ex.run_id = s.last_run_id), '') as excluded,
    coalesce(last_workspace_id = workspace_id, false) as is_last_workspace from {SESSIONS} s"""
)
def workspaces(t):
    out = bundles.workspace_details(BUNDLES.df(t.spark), SESSIONS.df(t.spark))
    return out.select("workspace_id", "session_id", "run_id", F.array_join("changed_files", ",").alias("changed"), F.array_join("excluded_files", ",").alias("excluded"), "is_last_workspace")


TRACES = Literal(
    "run_id string, workspace_path string, bundle string",
    ("t1", "/w", '{"apply_result": {"artifact": {"operation": "insert_after_symbol", "parent_qualname": "a"}, "impact": {"changed_symbols": ["a.F.go", "a.new", "tests.test_a.t"]}}}'),
    ("t2", "/w", '{"apply_result": {"artifact": {"operation": "insert_after_symbol", "parent_qualname": "c.d.x.K"}, "impact": {"changed_symbols": ["c.d.x.K.new", "z.new"]}}}'),
    ("t3", "/w", '{"apply_result": {"artifact": {"operation": "replace_symbol", "target_qualname": "a.F"}, "impact": {"target_qualname": "a.F", "changed_symbols": ["a.G"]}}, "execution_summary": {"selected_target": "tests.x"}}'),
    ("t4", "/w", '{"apply_result": {"impact": {"changed_symbols": ["b.only", "", "tests.q"]}}}'), ("t5", "/w", '{"execution_summary": {"operation": "insert_after_symbol", "parent_qualname": "c"}}'),
)
_js = lambda path: f"json_extract_string(bundle, '$.{path}')"


@case(
    f"""with s as (select qualname from {SYMBOLS} where kind <> 'module'), m as (select qualname as module from {SYMBOLS} where kind = 'module'),
    b as (select run_id, coalesce({_js('apply_result.artifact.operation')}, {_js('execution_summary.operation')}, '') = 'insert_after_symbol' as ins, coalesce({_js('apply_result.artifact.parent_qualname')}, {_js('execution_summary.parent_qualname')}) as parent,
      list_filter(list_concat({_j('apply_result.impact.changed_symbols')}, {_j('execution_summary.changed_symbols')}), lambda x: trim(x) <> '' and not starts_with(x, 'tests.')) as changed,
      list_filter([{_js('apply_result.artifact.target_qualname')}, {_js('apply_result.impact.target_qualname')}, {_js('execution_summary.selected_target')}], lambda x: coalesce(trim(x), '') <> '' and not starts_with(x, 'tests.')) as targets from {TRACES}),
    plain as (select run_id, unnest(case when len(targets) > 0 then targets else changed end) as target, 'symbol' as kind from b where not ins),
    known as (select run_id, target, 'symbol' as kind from (select run_id, unnest(changed) as target from b where ins) where target in (select qualname from s)),
    o as (select * from b where ins and run_id not in (select run_id from known)), up as (select run_id, q, string_split(q, '.') as p from (select run_id, unnest(changed) as q from o)),
    near as (select run_id, q, module, row_number() over (partition by run_id, q order by length(module) desc) as n from up join m on q like module || '.%'), mods as (select run_id, parent as target from o where parent in (select module from m) union select run_id, module from near where n = 1)
    select distinct * from plain union select * from known union select run_id, target, 'module' from mods"""
)
def traceability_targets(t):
    s = SYMBOLS.df(t.spark)
    return bundles.traceability_targets(TRACES.df(t.spark), s.where("kind <> 'module'"), s.where("kind = 'module'").select(F.col("qualname").alias("module")))


RESULTS = Literal(
    "unit int, result string, fallback_target string",
    (1, '{"status": "ok", "code_artifact": {"code": "x = 1", "import_changes": ["import a"]}}', "m.f"), (2, '{"status": "ok", "code_artifact": {"operation": "delete", "code": "x"}}', "m.f"), (3, '{"status": "ok", "code_artifact": {"operation": "insert_after_symbol", "target_qualname": "m.g", "insert_scope": ""}}', "m.f"),
    (4, '{"status": "error", "message": "bad", "planner_result": {"suggested_next_step": "retry"}}', "m.f"), (5, '{"status": "blocked", "planner_result": {"reason": "no plan"}}', "m.f"), (6, '{"error_type": "E"}', "m.f"),
)
_r = lambda path: f"json_extract_string(result, '$.{path}')"


@case(
    f"""select unit, coalesce(nullif({_r('code_artifact.target_qualname')}, ''), fallback_target) as target_qualname, {_r('code_artifact.code')} as code, coalesce({_r('code_artifact.operation')}, 'replace_symbol') as operation, nullif({_r('code_artifact.insert_scope')}, '') as insert_scope,
    coalesce(array_to_string(from_json(json_extract(result, '$.code_artifact.import_changes'), '["VARCHAR"]'), ','), '') as import_changes,
    case when coalesce({_r('status')}, 'None') <> 'ok' then coalesce({_r('status')}, 'None') || ' (' || coalesce({_r('message')}, {_r('planner_result.reason')}, {_r('error_type')}, {_r('status')}, 'None') || coalesce('. Suggested next step: ' || {_r('planner_result.suggested_next_step')}, '') || ')'
      when coalesce({_r('code_artifact.operation')}, 'replace_symbol') not in ('replace_symbol', 'insert_after_symbol') then 'unsupported operation: ' || {_r('code_artifact.operation')} when coalesce({_r('code_artifact.code')}, '') = '' then 'no code' end as error from {RESULTS}"""
)
def patch_artifacts(t):
    out = bundles.artifacts(RESULTS.df(t.spark))
    return out.select("unit", "target_qualname", "code", "operation", "insert_scope", F.array_join("import_changes", ",").alias("import_changes"), "error")


@query(
    """select event_type, count(*) as calls, sum(length(coalesce(props, '')))::bigint as texts, sum(user_id)::bigint as chars, count(value) as prompt_tokens, round(sum(coalesce(event_id * 1000, 0)) / 1e9, 6) as total_duration_sec, 0.0::double as load_duration_sec,
    string_agg(distinct event_type, ',' order by event_type) as models, string_agg(distinct (user_id % 3)::varchar, ',' order by (user_id % 3)::varchar) as endpoints from events group by 1"""
)
def embedding_usage(t):
    calls = t("events").selectExpr("event_type", "event_type as model", "cast(user_id % 3 as string) as endpoint", "length(coalesce(props, '')) as texts", "user_id as chars", "if(value is null, 0, 1) as prompt_tokens", "event_id * 1000 as total_duration", "cast(null as long) as load_duration")
    out = bundles.embedding_usage(calls, ["event_type"])
    whole = [F.col(c).cast("long").alias(c) for c in ("calls", "texts", "chars", "prompt_tokens")]
    return out.select("event_type", *whole, "total_duration_sec", "load_duration_sec", F.array_join("models", ",").alias("models"), F.array_join("endpoints", ",").alias("endpoints"))


@query(
    """select conv_id, case when grouping(role) = 1 then 'request' else role end as part, count(text) as items, coalesce(sum(length(text)), 0)::bigint as chars from conversations group by rollup (conv_id, role) having grouping(conv_id) = 0"""
)
def request_metrics(t):
    """Items and characters of the parts of requests: conversations by role."""
    return bundles.request_metrics(t("conversations").select("conv_id", F.col("role").alias("part"), "text"), ["conv_id"])


@query("""select 'lang' as facet, lang as value from documents where lang is not null group by lang union all select 'source', source from documents where source is not null group by source""")
def run_facets(t):
    return bundles.facets(t("documents"), "lang", "source")


@query("""select (select count(distinct r_name) from region) as modules, (select count(distinct n_name) from nation) as symbols, (select count(distinct c_custkey) from customer) as requirements""")
def knowledge_counts(t):
    return bundles.knowledge_counts(t("region").select(F.col("r_name").alias("module")), t("nation").select(F.col("n_name").alias("qualname")), t("customer").select(F.col("c_custkey").alias("req_id")))


@query("""select count(*) as documents, 0::bigint as changed, true as skipped, 'disabled' as reason from documents""")
def sync_skipped(t):
    return bundles.skipped_sync(t("documents"), "disabled")


REJECTED = Literal("run_id string, file_path string", ("r", "tests/a.py"), ("r", "./tests/a.py"), ("r", "/tests/b.py"), ("r", "tests/../c.py"), ("r", "src/d.py"), ("r", "tests/e.py"))
PRESENT = Literal("run_id string, file_path string", ("r", "tests/a.py"), ("r", "tests/b.py"), ("r", "tests/../c.py"), ("r", "src/d.py"))


@case(f"""select distinct run_id, {_rel.format('file_path')} as file_path from {REJECTED} where regexp_matches({_rel.format('file_path')}, '^tests/.*\\.py$') and not list_contains(string_split({_rel.format('file_path')}, '/'), '..') and (run_id, {_rel.format('file_path')}) in (select (run_id, file_path) from {PRESENT})""")
def rejected_test_files(t):
    return bundles.rejected_files(REJECTED.df(t.spark), PRESENT.df(t.spark))


# --- texts, tree and workspace --------------------------------------------------


@query(
    r"""with p as (select p_partkey, p_name, p_type, p_brand from part)
    select p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(p_brand || ' ' || p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])|([0-9])([A-Za-z])', '\1\3 \2\4', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))), ',') as identifier,
    trim(translate(p_brand || '_' || p_type || '-', '_-', '  ')) as human, case when p_partkey * 977 % 200000 < 60000 then printf('%.1fs', (p_partkey * 977 % 200000) / 1000.0) else ((p_partkey * 977 % 200000) // 60000) || 'm ' || ((p_partkey * 977 % 200000) % 60000 // 1000) || 's' end as took,
    length(left(p_type, 9)) as head from p"""
)
def identifier_texts(t):
    c = F.concat_ws(" ", "p_brand", "p_name")
    ms = F.expr("p_partkey * 977 % 200000")
    return t("part").select("p_partkey", F.array_join(F.array_sort(text.identifier_tokens(c)), ",").alias("identifier"), text.humanised(F.concat(F.col("p_brand"), F.lit("_"), F.col("p_type"), F.lit("-"))).alias("human"), text.duration_text(ms).alias("took"), F.length(F.substring("p_type", 1, 9)).alias("head"))


@query(
    r"""with l as (select page_id, list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, '@'))[1:4] as u, string_split(html, chr(10)) as s, html from pages)
    select page_id, array_to_string(case when len(list_filter(u, lambda x: ends_with(x, '>'))) >= 0 then (case when list_position(list_transform(u, lambda x: ends_with(x, ':')), true) > 0 then u[1:list_position(list_transform(u, lambda x: ends_with(x, ':')), true)] else u end) end, ' ') as signature,
    sha256(array_to_string(list_concat(list_concat(s[1:1], ['new', 'line']), s[3:]), chr(10))) as spliced, sha256(array_to_string(list_concat(list_concat(s[1:2], ['new', 'line']), s[3:]), chr(10))) as after,
    case when length(html) <= 80 then html else left(html, greatest(0, 80 - length(chr(10) || '# ... truncated, original_chars=' || length(html)))::int) || chr(10) || '# ... truncated, original_chars=' || length(html) end as cut,
    array_to_string(case when len(s) <= 3 then s else s[2:3] end, '/') as snippet from l where len(s) >= 2"""
)
def source_edits(t):
    """Signatures, splices, cuts and snippets of the pages' sources."""
    rows = t("pages").where(F.size(F.split("html", "\n")) >= 2)
    html, new = F.col("html"), F.lit("new\nline")
    return rows.select(
        "page_id", text.signature("html").alias("signature"), F.sha2(workspace.spliced(html, F.lit(2), F.lit(2), new), 256).alias("spliced"), F.sha2(workspace.spliced(html, F.lit(2), F.lit(2), new, after=True), 256).alias("after"),
        text.truncated_source("html", 80).alias("cut"), F.replace(sources.snippet(html, F.lit(2), F.lit(3), 3), F.lit("\n"), F.lit("/")).alias("snippet"),
    )


NOTE_TYPES = Literal("id int, expected string, actual string", (1, "typing.List[int]", "list"), (2, "'DateTime'", "datetime.datetime"), (3, "int", "str"), (4, "", "str"), (5, "pathlib.PurePath", "Path"), (6, "Sequence[Order]", "tuple"), (7, "Order", "shop.Order"), (8, None, "x")).over("part", "p_partkey", actual="case when k.p_size % 4 = 0 then v.expected else v.actual end")
_aliases = {"DateTime": "datetime", "Datetime": "datetime", "List": "list", "Dict": "dict", "Set": "set", "Tuple": "tuple", "Sequence": "list", "MutableSequence": "list", "PathLike": "Path", "PurePath": "Path", "PurePosixPath": "Path", "PureWindowsPath": "Path"}
_bare_type = lambda c: f"string_split(regexp_replace(regexp_replace(replace(replace(trim({c}), '''', ''), '\"', ''), 'typing\\.', ''), '\\[.*$', ''), '.')[-1]"
_type = lambda c: f"(case {_bare_type(c)} " + " ".join(f"when '{k}' then '{v}'" for k, v in _aliases.items()) + f" else {_bare_type(c)} end)"


@query(
    f"""select id, {_type('expected')} as expected, {_type('actual')} as actual, coalesce({_type('expected')} = '' or {_type('actual')} = '' or {_type('expected')} = {_type('actual')}, true) as fits,
    nullif(trim(regexp_extract(expected, '^(?:typing\\.)?(?:[Ll]ist|[Ss]et|[Tt]uple|FrozenSet|frozenset|Sequence|Iterable)\\[([^\\[\\],]+)', 1)), '') as item from {NOTE_TYPES}"""
)
def type_names(t):
    e, a = F.col("expected"), F.col("actual")
    return NOTE_TYPES.of(t).select("id", text.type_name(e).alias("expected"), text.type_name(a).alias("actual"), text.types_fit(e, a).alias("fits"), contracts.item_type(e).alias("item"))


OUTPUTS = Literal("id int, body string", (1, 'FAILED tests/a.py::t - x\n  File "b.py", line 1\nERROR tests/a.py'), (2, "ok\n\n\n all good \n"), (3, None), (4, "run `a.b.c` then self.x.y and Svc.go or a.b and `m.py`")).over("documents", "doc_id", body=("concat(v.body, char(10), k.text)", "v.body || chr(10) || k.text"))


@query(
    f"""select id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ',') as paths, left(array_to_string(list_filter(string_split(coalesce(body, ''), chr(10)), lambda l: trim(l) <> '')[1:2], chr(10)), 30) as excerpt from (
      select *, list_transform(regexp_extract_all(coalesce(body, ''), '(?m)^(?:FAILED|ERROR)\\s+\\S+?\\.py|File "[^"]+\\.py"'), lambda v: regexp_replace(regexp_replace(v, '^(FAILED|ERROR)\\s+', ''), '^File "|"$', '', 'g')) as x from {OUTPUTS})"""
)
def failure_texts(t):
    c = F.col("body")
    return OUTPUTS.of(t).select("id", F.array_join(decisions.failed_paths(c), ",").alias("paths"), decisions.failure_excerpt(c, 2, 30).alias("excerpt"))


TARGETS = Literal("target string", ("a.py",), ("a.py::t",), ("b.py",), ("tests.t.C.m",), ("tests.t.gone",), ("tests.t",), ("no.such",))
TEST_FILES = Literal("file_path string", ("tests/t.py",))
TEST_NODES = Literal("path string, node string", ("tests/t.py", "C::m"))


@case(
    f"""with t as (select * from {TARGETS} where target not in (select string_split(target, '::')[1] from {TARGETS} where contains(target, '::'))), p as (select target, string_split(target, '.') as p from t),
    e as (select target, n, array_to_string(p[1:n], '/') || '.py' as path, array_to_string(p[n + 1:], '::') as node from p, (select unnest(range(1, 9)) as n) where n <= len(p)),
    h as (select e.*, node = '' or (path, node) in (select (path, node) from {TEST_NODES}) as has from e where path in (select file_path from {TEST_FILES})), b as (select * from h qualify row_number() over (partition by target order by has desc, n desc) = 1)
    select t.target, case when has then path || case when node <> '' then '::' || node else '' end else path end as path, case when path is null then 'unresolved' when has then 'resolved' else 'fallback_file' end as status from t left join b using (target)"""
)
def test_targets(t):
    deduped = workspace.deduped_targets(TARGETS.df(t.spark))
    return workspace.resolved_targets(deduped, TEST_FILES.df(t.spark), TEST_NODES.df(t.spark))


PATHS = Literal("file_path string, sha string", ("./a/b.py", "1"), ("a\\b\\c.py", "1"), (".venv/x.py", "1"), ("img/x.PNG", "1"), ("tests/test_generated_x.py", "1"), ("src/tests/y.py", "1"), ("z.py", "2"))
OTHER = Literal("file_path string, sha string", ("a/b.py", "1"), ("z.py", "3"), ("new.py", "1"))


@case(
    f"""with n as (select regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '') as file_path, sha from {PATHS})
    select n.file_path, list_contains(string_split(n.file_path, '/'), '.venv') or ends_with(lower(n.file_path), '.png') as skipped, contains('/' || n.file_path, '/tests/') as is_test, regexp_matches(n.file_path, '^tests/(.*/)?test_generated_[^/]*\\.py$') as generated,
    case when o.file_path is null or o.sha <> n.sha then true else false end as differs, replace(regexp_replace(n.file_path, '\\.py$', ''), '/', '.') as module from n left join {OTHER} o using (file_path)"""
)
def path_rules(t):
    from ..sources.code import module_name

    c = F.col("file_path")
    rows = PATHS.df(t.spark).select(diff.normal_path(c).alias("file_path"), F.col("sha").alias("sha256"))
    other = OTHER.df(t.spark).select("file_path", F.col("sha").alias("sha256"))
    changed = diff.tree_changes(rows, other).withColumn("differs", F.lit(True))
    out = rows.join(changed, "file_path", "left")
    return out.select("file_path", store.skipped_path(c, (".venv",), (), (".png",)).alias("skipped"), graph.is_test_path(c).alias("is_test"), services.generated_test_path(c).alias("generated"), F.coalesce("differs", F.lit(False)).alias("differs"), module_name(c).alias("module"))


GUARDED = Literal("file_path string, s boolean, d boolean", ("a", True, True), ("b", True, False), ("c", False, True), ("e", False, False))


@case(f"""select file_path, case when s then 'copied' when d then 'deleted' else 'none' end as action from {GUARDED}""")
def apply_actions(t):
    g = GUARDED.df(t.spark)
    return diff.apply_actions(g, g.where("s"), g.where("d"))


# --- knowledge and graph --------------------------------------------------------

LISTS = Literal("id int, a array<string>, b array<string>, csv string, history array<string>, item string", (1, [" x", "y"], ["y ", "", "z"], "R2, ,R3", ["h", "h2"], "h"), (2, [], [], "", [], "new"), (3, None, ["q", "q"], None, ["a", "", "a"], "")).over("part", "p_partkey", a=("case when v.a is not null then concat(v.a, array(k.p_name)) end", "case when v.a is not null then list_append(v.a, k.p_name) end"), csv="v.csv || ',' || k.p_brand")


@query(
    f"""with r as (select *, list_filter(list_transform(list_concat(coalesce(a, {_none}), coalesce(b, {_none})), lambda x: trim(x)), lambda x: x <> '') as m, list_filter(list_transform(list_concat(coalesce(a, {_none}), string_split(coalesce(csv, ''), ',')), lambda x: trim(x)), lambda x: x <> '') as ids,
      list_concat(list_filter(history, lambda x: x <> ''), case when item <> '' then [item] else {_none} end) as h from {LISTS})
    select id, array_to_string({_ordered.format('m')}, ',') as merged, array_to_string({_ordered.format('ids')}, ',') as ids, array_to_string({_ordered.format('h')}, ',') as history from r"""
)
def merged_lists(t):
    c = F.col
    join = lambda x: F.array_join(x, ",")
    return LISTS.of(t).select("id", join(knowledge.merged_list(c("a"), c("b"))).alias("merged"), join(services.requirement_ids(c("a"), c("csv"))).alias("ids"), join(services.appended(c("history"), c("item"))).alias("history"))


@query(
    """with d as (select n_name as k, 'n' || n_nationkey as title, n_regionkey::varchar as descr from nation), e as (select n_name as k, case when n_nationkey % 2 = 0 then 'curated' else ' ' end as title, null::varchar as descr from nation where n_nationkey % 3 = 0 union all select 'GONE', 'x', 'y')
    select d.k as name, coalesce(case when trim(e.title) <> '' then e.title end, d.title) as title, coalesce(case when trim(e.descr) <> '' then e.descr end, d.descr) as descr, 'merged' as list from d left join e using (k) union all select k, title, descr, 'unknown' from e where k not in (select k from d)"""
)
def knowledge_merge(t):
    derived = t("nation").selectExpr("n_name as name", "concat('n', n_nationkey) as title", "cast(n_regionkey as string) as descr")
    curated = t("nation").where("n_nationkey % 3 = 0").selectExpr("n_name as name", "if(n_nationkey % 2 = 0, 'curated', ' ') as title", "cast(null as string) as descr").unionByName(t.spark.createDataFrame([("GONE", "x", "y")], "name string, title string, descr string"))
    kept, unknown = knowledge.unknown_keys(curated, derived, "name")
    return knowledge.merged(kept, derived, "name", ["title", "descr"]).withColumn("list", F.lit("merged")).unionByName(unknown.withColumn("list", F.lit("unknown")))


DOC = {
    "modules": {"m.a": {"title": "A", "layer": "services"}, "m.b": {"description": "B"}, "m.c": {"layer": ""}},
    "symbols": {"m.a.f": {"title": "F", "requirements": ["R1", "R2"], "keywords": ["k"]}, "m.b.g": {"requirements": ["R2"]}},
    "requirements": {"R1": {"title": "one", "linked_symbols": ["m.b.g", "m.a.f"]}, "R2": {"description": "two", "linked_symbols": ["m.a.f"]}, "R3": {}},
    "architecture": {"layers": {"api": ["m.c", "m.a"], "storage": {"modules": ["m.c", "m.d"]}}},
}
K_LINKS = Literal("req_id string, qualname string, pos int, side int", ("R1", "m.a.f", 0, 0), ("R2", "m.a.f", 1, 0), ("R2", "m.b.g", 0, 0), ("R1", "m.b.g", 0, 1), ("R1", "m.a.f", 1, 1), ("R2", "m.a.f", 0, 1))
K_REQS = Literal("req_id string, title string, description string", ("R1", "one", None), ("R2", None, "two"), ("R3", None, None))
K_LAYERS = Literal("module string, own string, listed string", ("m.a", "services", "api"), ("m.b", None, None), ("m.c", None, "api"), ("m.d", None, "storage"))


@case(
    f"""select qualname, req_id, (row_number() over (partition by qualname order by o, req_id) - 1)::int as ord, coalesce(nullif(title, ''), req_id) as title, coalesce(description, '') as description from (select qualname, req_id, min(side * 100 + pos) as o from {K_LINKS} group by 1, 2) left join {K_REQS} using (req_id)"""
)
def requirement_details(t):
    return knowledge.requirement_details(knowledge.from_document(t.spark, DOC))


@case(
    f"""select distinct * from (select module as source_qualname, 'belongs_to_layer' as relation_kind, coalesce(own, listed) as target_ref from {K_LAYERS} where coalesce(own, listed) is not null union all select req_id, 'implements_requirement', qualname from {K_LINKS} where side = 1 union all select qualname, 'implements_requirement', req_id from {K_LINKS} where side = 0)"""
)
def knowledge_edges(t):
    """Layers of modules and the edges that knowledge implies."""
    return knowledge.relations(knowledge.from_document(t.spark, DOC)).select("source_qualname", "relation_kind", "target_ref")


RELATIONS = Literal(
    "file_path string, source_qualname string, relation_kind string, target_ref string, target_qualname string, relation_confidence string, ord long",
    ("a.py", "a", "imports", "json", "json", "medium", 1), ("a.py", "a", "imports", "D", "c.d.x.D", "high", 2), ("a.py", "a.F.go", "calls", "last", "a.last", "high", 3), ("a.py", "a.last", "calls", "go", "c.d.x.go", "high", 4), ("a.py", "a.F", "contains", "go", "a.F.go", "high", 5),
    ("tests/test_a.py", "tests.test_a.test_go", "calls", "go", "a.F.go", "high", 6), ("tests/test_a.py", "tests.test_a.test_go", "covered_by_test", "go", "a.F.go", "high", 7), ("b.py", "b", "imports", "G", "c.d.x.gone", "low", 8), ("b.py", "b.only", "calls", "print", None, "low", 9), ("b.py", "b.only", "calls", "last", None, "low", 10),
)


@case(
    f"""with t as (select qualname from {SYMBOLS} where contains('/' || file_path, '/tests/')), e as (select source_qualname as s, target_qualname as d from {RELATIONS} where relation_kind in ('calls', 'covered_by_test', 'exposed_by_controller') and target_qualname is not null),
    r1 as (select distinct d as root, s as node, 1 as hops from e), p1 as (select * from r1 where node in (select qualname from {SYMBOLS} where not contains('/' || file_path, '/tests/'))),
    r2 as (select distinct p1.root, e.s as node, 2 as hops from p1 join e on e.d = p1.node), p2 as (select * from r2 where node in (select qualname from {SYMBOLS} where not contains('/' || file_path, '/tests/'))), r3 as (select distinct p2.root, e.s as node, 3 as hops from p2 join e on e.d = p2.node),
    a as (select root, node, min(hops)::int as hops from (select * from r1 union all select * from r2 union all select * from r3) where root <> node group by 1, 2)
    select root, node as test, hops, (select 'pytest ' || min(file_path) from {SYMBOLS} where qualname = node) as command from a where node in (select qualname from t) and root in ('a.last', 'c.d.x.go', 'a.F.go')"""
)
def related_tests(t):
    s, r = SYMBOLS.df(t.spark), RELATIONS.df(t.spark)
    start = t.spark.createDataFrame([(x, x) for x in ("a.last", "c.d.x.go", "a.F.go")], "root string, node string")
    tests = graph.related_tests(r, s, start)
    commands = graph.test_commands(tests, s)
    files = s.select(F.col("qualname").alias("test"), F.concat(F.lit("pytest "), F.col("file_path")).alias("command"))
    return tests.join(files, "test").join(commands, "command", "left_semi").select("root", "test", "hops", "command")


@case(
    f"""with s as {SYMBOLS}, r as {RELATIONS}, shown as (select * from r where relation_kind <> 'contains'), t as (select * from s where qualname in ('a.F.go', 'a.last', 'b.only')),
    near as (select t.qualname, o.qualname as other, row_number() over (partition by t.qualname order by o.start_line, o.qualname) as n from t join s o using (file_path) where o.qualname <> t.qualname),
    o as (select qualname, coalesce(target_qualname, target_ref) as other, relation_confidence, row_number() over (partition by qualname order by relation_kind, coalesce(target_qualname, target_ref), ord) as n from t join shown on source_qualname = qualname),
    i0 as (select qualname, source_qualname as other, relation_confidence, ord from t join shown on target_qualname = qualname), i as (select *, row_number() over (partition by qualname order by other, ord) as n from (select * from i0 union all
      select qualname, source_qualname, relation_confidence, ord from t join shown on target_ref = name where qualname not in (select qualname from i0))), c as (select qualname, relation_confidence as x from o union all select qualname, relation_confidence from i)
    select t.qualname, coalesce((select string_agg(other, ',' order by n) from near where near.qualname = t.qualname and n <= 8), '') as neighbors, coalesce((select string_agg(other, ',' order by n) from o where o.qualname = t.qualname and n <= 16), '') as outbound, coalesce((select string_agg(other, ',' order by n) from i where i.qualname = t.qualname and n <= 16), '') as inbound,
    (select count(*) from c where c.qualname = t.qualname and x = 'high') as high, (select count(*) from c where c.qualname = t.qualname and x = 'low') as low from t"""
)
def neighbourhoods(t):
    """Context of targets: neighbours, edges both ways and their confidence."""
    targets = t.spark.createDataFrame([("a.F.go",), ("a.last",), ("b.only",)], "qualname string")
    pack = graph.context_pack(SYMBOLS.df(t.spark), RELATIONS.df(t.spark), targets)
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.other), ","), F.lit("")).alias(c)
    return pack.select("qualname", names("neighbors"), names("outbound"), names("inbound"), "high", "low")


@case(
    f"""select 'outbound' as lookup, source_qualname as a, coalesce(target_qualname, target_ref) as b from {RELATIONS} where source_qualname = 'a' union all select 'root', string_split(coalesce(target_qualname, target_ref), '.')[1], null from {RELATIONS} where relation_kind = 'imports' group by 2
    union all select 'child', s.parent_qualname, e.target_ref from {SYMBOLS} s join {RELATIONS} e on s.qualname = e.source_qualname where s.kind = 'method' union all select 'unique', name, min(qualname) from {SYMBOLS} group by name having count(*) = 1
    union all select 'type', regexp_replace(source_qualname, '\\.[^.]+$', ''), regexp_replace(target_qualname, '\\.[^.]+$', '') from {RELATIONS} where relation_kind = 'calls' and target_qualname is not null and regexp_replace(source_qualname, '\\.[^.]+$', '') <> regexp_replace(target_qualname, '\\.[^.]+$', '') group by all
    union all select 'import', source_qualname, target_ref from {RELATIONS} where relation_kind = 'imports' union all select 'member', parent_qualname, name from {SYMBOLS} where kind = 'method' and (not starts_with(name, '_') or name = '__init__')
    union all select 'direct', 'a', name from {SYMBOLS} where starts_with(qualname, 'a.') and not contains(substring(qualname, 3), '.') and name <> '__init__'"""
)
def symbol_lookups(t):
    """Lookups over symbols and edges."""
    s, r = SYMBOLS.df(t.spark), RELATIONS.df(t.spark)
    row = lambda df, name, a, b: df.select(F.lit(name).alias("lookup"), F.col(a).cast("string").alias("a"), (F.col(b) if b else F.lit(None)).cast("string").alias("b"))
    out = row(store.outbound(r, "a").withColumn("to", F.coalesce("target_qualname", "target_ref")), "outbound", "source_qualname", "to")
    out = out.unionByName(row(store.import_roots(r), "root", "root", None)).unionByName(row(graph.children(s, r), "child", "class_qualname", "target_ref")).unionByName(row(graph.unique_names(s, "name", "qualname"), "unique", "name", "qualname"))
    out = out.unionByName(row(contracts.attribute_types(r), "type", "class", "type")).unionByName(row(contracts.import_rows(r), "import", "module", "alias"))
    classes = s.where("kind = 'class'").select(F.col("qualname").alias("class_qualname"))
    out = out.unionByName(row(contracts.required_members(s, classes), "member", "class_qualname", "member"))
    return out.unionByName(row(services.direct_children(s, "a").withColumn("p", F.lit("a")), "direct", "p", "name"))


@case(
    f"""with k as (select qualname as module from {SYMBOLS} where kind = 'module'), s as (select qualname, module_name from {SYMBOLS} where kind <> 'module'), n as (select qualname, module, row_number() over (partition by qualname order by length(module) desc) as n from s join k on qualname like module || '.%' or qualname = module)
    select s.qualname, coalesce(case when s.qualname in ('a.F', 'b.only') then s.qualname end, k.module, n.module) as target, case when s.qualname in ('a.F', 'b.only') then 'symbol' when k.module is not null then 'module' when n.module is not null then 'nearest_module' end as how
    from s left join k on s.module_name = k.module left join n on s.qualname = n.qualname and n.n = 1"""
)
def traced_symbols(t):
    s = SYMBOLS.df(t.spark)
    known = t.spark.createDataFrame([("a.F",), ("b.only",)], "qualname string")
    return services.traced(s.where("kind <> 'module'"), known, s.where("kind = 'module'").select(F.col("qualname").alias("module")))


REFS = Literal("id int, ref string", (1, "a"), (2, "c/d/x.py"), (3, "c.d.x.py"), (4, "x"), (5, "zzz"), (6, "c/__init__.py")).over("orders", "o_orderkey")


@query(
    f"""with m as (select distinct file_path, qualname as module from {SYMBOLS} where kind = 'module'), t as (select 1 as o, 'module' as step, module as ref, module as target from m union all select 2, 'file', file_path, module from m union all select 3, 'path', replace(file_path, '/', '.'), module from m union all select 4, 'tail', string_split(module, '.')[-1], module from m),
    u as (select o, step, ref, min(target) as target from t group by 1, 2, 3 having count(*) = 1)
    select id, r.ref, arg_min(target, o) as target, arg_min(step, o) as step from {REFS} r left join u using (ref) group by 1, 2"""
)
def module_references(t):
    return services.module_refs(REFS.of(t), SYMBOLS.df(t.spark)).select("id", "ref", "target", "step")


LAYER_ROWS = Literal("layer string, module string", ("old", "a"), ("api", "c"), ("api", "gone"))
NEW_LAYERS = Literal("layer string, module string", ("api", "a"), ("api", "zz"), ("data", "c.d.x"), ("api", "a"))


@case(
    f"""with k as (select qualname as module from {SYMBOLS} where kind = 'module') select layer, module, 'kept' as list from {LAYER_ROWS} where layer not in (select layer from {NEW_LAYERS}) union select layer, module, 'kept' from {NEW_LAYERS} where module in (select module from k) union select layer, module, 'unknown' from {NEW_LAYERS} where module not in (select module from k)"""
)
def layers_replaced(t):
    known = SYMBOLS.df(t.spark).where("kind = 'module'").select(F.col("qualname").alias("module"))
    kept, odd = services.merged_layers(LAYER_ROWS.df(t.spark), NEW_LAYERS.df(t.spark), known)
    return kept.withColumn("list", F.lit("kept")).unionByName(odd.withColumn("list", F.lit("unknown")))


@query(
    """with l as (select o_custkey as req_id, 'c' || (o_orderkey % 5) as change_request_id, o_orderdate::varchar as applied_at from orders), a as (select c_custkey as req_id, case when c_custkey % 2 = 0 then 'c1' else ' ' end as change_request_id, '1999' as applied_at from customer)
    select req_id, change_request_id, max(applied_at) as applied_at from (select * from l union all select * from a) where trim(change_request_id) <> '' group by 1, 2"""
)
def traceability_history(t):
    links = t("orders").select(F.col("o_custkey").alias("req_id"), F.expr("concat('c', o_orderkey % 5)").alias("change_request_id"), F.col("o_orderdate").cast("string").alias("applied_at"))
    applied = t("customer").select(F.col("c_custkey").alias("req_id"), F.expr("if(c_custkey % 2 = 0, 'c1', ' ')").alias("change_request_id"), F.lit("1999").alias("applied_at"))
    return knowledge.traceability(links, applied)


# --- searches, usage and contracts ----------------------------------------------


@query(
    """with i as (select *, row_number() over (partition by conv_id order by turn, role, text) as ord from conversations), f as (select conv_id, role, min(ord) as o from i where length(text) > 40 group by 1, 2)
    select conv_id, string_agg(role, ',' order by o) as codes from f group by 1"""
)
def failed_codes(t):
    """Distinct codes of failed blocks in the order first seen: roles of long turns."""
    rows = t("conversations").withColumn("ord", F.expr("row_number() over (partition by conv_id order by turn, role, text)"))
    issues = rows.select("conv_id", F.col("role").alias("code"), (F.length("text") <= 40).alias("ok"), "ord")
    return usage.failed_codes(issues, ["conv_id"]).select("conv_id", F.array_join("codes", ",").alias("codes"))


@query(
    """with f as (select distinct p_brand as file_path from part order by 1 limit 10), s as (select p_brand as file_path, 'p' || p_partkey as qualname, p_size as start_line from part where p_brand in (select file_path from f))
    select file_path, qualname, rank::int as rank from (select *, row_number() over (partition by file_path order by start_line, qualname) as rank from s) where rank <= 12"""
)
def project_map(t):
    """The first files and their first symbols: brands and parts."""
    s = t("part").select(F.col("p_brand").alias("file_path"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("qualname"), F.col("p_size").alias("start_line"), F.lit("function").alias("kind"))
    return usage.project_map(s).select("file_path", "qualname", "rank")


RUNS = Literal("path string, run_id string, project string, ok boolean, ms array<string>, total_tokens string, generated_tests long", ("p3", "r3", "x", None, [], "x", 0), ("p1", "r1", "x", True, ["5", None], "12", 1), ("p2", "R2", "y", False, ["7", "8"], None, None))


@case(
    f"""select path, run_id, case when ok is null then 'unknown' when ok then 'passed' else 'failed' end as status, coalesce(list_sum(list_transform(ms, lambda x: coalesce(x::bigint, 0))), 0)::bigint as duration_ms, coalesce(try_cast(total_tokens as bigint), 0) as total_tokens, coalesce(generated_tests, 0) > 0 as had_generated_tests,
    ok is not null and ok and contains(lower(run_id), 'r') as filtered from {RUNS}"""
)
def run_table(t):
    rows = RUNS.df(t.spark).withColumn("steps", F.transform("ms", lambda x: F.struct(x.cast("bigint").alias("duration_ms"))))
    out = usage.runs_table(rows)
    hit = usage.filtered_runs(out, "x", "passed", "R", ["run_id"]).select("run_id", F.lit(True).alias("filtered"))
    return out.join(hit, "run_id", "left").select("path", "run_id", "status", "duration_ms", "total_tokens", "had_generated_tests", F.coalesce("filtered", F.lit(False)).alias("filtered"))


HITS = Literal("qualname string, score double, query_pos int, pos int", ("a.F", 3.0, 0, 0), ("a.last", 3.0, 1, 1), ("a.F", 5.0, 1, 2), ("b.only", 1.0, 0, 3), ("a.last", 3.0, 0, 4))
RANKED = Literal("qualname string, rank int", ("b.only", 1), ("a.last", 2), ("b.only", 3))


@case(
    f"""with u as (select qualname, score, query_pos from {HITS} qualify row_number() over (partition by qualname order by score desc, query_pos) = 1), h as (select * from u union all select qualname, 100.0, -1 from {SYMBOLS} where (name in ('go', 'a.F') or qualname in ('go', 'a.F')) and qualname not in (select qualname from u)),
    o as (select h.*, row_number() over (order by query_pos, qualname) - 1 as p from h), r as (select qualname, min(rank) as rank from {RANKED} group by 1)
    select qualname, score, query_pos, (row_number() over (order by r.rank nulls last, p))::int as place, (row_number() over (order by case when qualname = 'a.last' then 0 else 1 end, p))::int as moved from o left join r using (qualname)"""
)
def candidate_lists(t):
    """Results of several queries as one list, with outright names, reranked."""
    found = search.with_hints(search.union_best(HITS.df(t.spark).drop("pos"), "qualname", 12), SYMBOLS.df(t.spark), ["go", "a.F"])
    at = found.withColumn("pos", F.expr("row_number() over (order by query_pos, qualname) - 1"))
    place = search.reordered(at, RANKED.df(t.spark)).withColumn("place", F.expr("cast(monotonically_increasing_id() + 1 as int)"))
    place = place.withColumn("place", F.expr("cast(row_number() over (order by place) as int)"))
    moved = search.moved_first(at, "a.last", 0.9).select("qualname", F.expr("monotonically_increasing_id()").alias("_m")).withColumn("moved", F.expr("cast(row_number() over (order by _m) as int)")).drop("_m")
    return place.join(moved, "qualname").select("qualname", "score", "query_pos", "place", "moved")


@query(
    f"""with h as (select item_id::varchar as artifact_id, lower('item ' || item_id || chr(10) || text) as hay, item_id % 3 as k from benchmark),
    s as (select artifact_id, 1.5 * (select count(*) from (select unnest(list_filter(regexp_extract_all('использовать the thing and anonymous the end', '{text.REFERENCE_TERM_PATTERN}'), lambda w: w not in {in_sql(text.REFERENCE_STOP_WORDS)})) as w) where contains(hay, w)) + case when k = 0 then 0.3 else 0 end + case when k = 1 then 0.2 else 0 end as score from h)
    select artifact_id, round(score, 4) as score from s where score > 0 order by score desc, artifact_id limit 5"""
)
def reference_search(t):
    """Reference artefacts for a request: the benchmark's items."""
    docs = t("benchmark").select(F.col("item_id").cast("string").alias("artifact_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"), "text", F.expr("if(item_id % 3 = 0, 'reusable_component', 'template')").alias("artifact_type"), F.expr("if(item_id % 3 = 1, 'reuse', 'adapt')").alias("usage_mode"))
    return search.reference_topk(docs, "использовать the thing and anonymous the end", 5).select("artifact_id", F.round("score", 4).alias("score"))


@query(
    """select p_brand as target, qualname, rank::int as rank from (select p_brand, 'p' || p_partkey as qualname, row_number() over (partition by p_brand order by p_size % 2 = 0, length(p_name), 'p' || p_partkey) as rank from part) where rank <= 2"""
)
def selected_tests(t):
    tests = t("part").select(F.col("p_brand").alias("target"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("qualname"), F.col("p_name").alias("source_code"), (F.col("p_size") % 2 == 0).alias("is_module"))
    return contracts.selected_tests(tests, 2).select("target", "qualname", "rank")


CONSUMED = Literal("file_path string, relation_kind string, target_qualname string", ("b.py", "imports", "m.gone"), ("a.py", "imports", "m.two"), ("a.py", "imports", "m.one"), ("c.py", "imports", "m.here"), ("tests/t.py", "imports", "m.gone"), ("d.py", "calls", "m.gone"))
SOURCES = Literal("id int, body string", (1, "import a\nx\nname()\nnames\ny\nz = name"), (2, "from b import name\nname\n"), (3, ""))


@case(
    f"""select file_path as a, string_agg(distinct substring(target_qualname, 3), ',' order by substring(target_qualname, 3)) as b from {CONSUMED} where relation_kind = 'imports' and starts_with(target_qualname, 'm.') and not contains('/' || file_path, '/tests/') and target_qualname <> 'm.here' group by 1
    union all select id::varchar, (with l as (select unnest(string_split(body, chr(10))) as x, generate_subscripts(string_split(body, chr(10)), 1) as i), k as (select x, i, lag(i) over (order by i) as p from l where regexp_matches(x, '^\\s*(import|from)\\s') or regexp_matches(x, '(^|[^A-Za-z0-9_])(name)([^A-Za-z0-9_]|$)'))
      select coalesce(string_agg(case when p < i - 1 then '...' || chr(10) || x else x end, chr(10) order by i), '') from k) from {SOURCES}"""
)
def consumer_texts(t):
    """Consumers of names a module lacks, and excerpts of sources around names."""
    c = contracts.consumers(CONSUMED.df(t.spark), "m", ["here"]).select(F.col("file_path").alias("a"), F.array_join("names", ",").alias("b"))
    e = SOURCES.df(t.spark).select(F.col("id").cast("string").alias("a"), contracts.excerpt(F.col("body"), F.array(F.lit("name"))).alias("b"))
    return c.unionByName(e)


@query(
    """with r as (select conv_id, turn, role, case when turn % 3 = 0 then '' else 'q' || (turn % 4) end as qualname, role as name from conversations), k as (select *, coalesce(nullif(qualname, ''), name) as key from r)
    select conv_id, key, min(turn) as turn from k group by 1, 2"""
)
def payload_dedupe(t):
    """The first of each qualified name, or of each name where that is missing."""
    rows = t("conversations").select("conv_id", F.col("turn").alias("ord"), F.expr("concat(conv_id, '|', if(turn % 3 = 0, '', concat('q', turn % 4)))").alias("q"), F.expr("concat(conv_id, '|', role)").alias("name"))
    rows = rows.withColumn("qualname", F.when(F.col("q").endswith("|"), "").otherwise(F.col("q"))).drop("q")
    out = contracts.deduped_payloads(rows)
    key = F.coalesce(F.nullif("qualname", F.lit("")), "name")
    return out.select("conv_id", F.substring_index(key, "|", -1).alias("key"), F.col("ord").alias("turn"))


PROJECTS = Literal("project_id string, project_root string", ("a", "/r"), ("b", "/r"), ("c", "/s/"))
NEW_PROJECTS = Literal("project_id string, project_root string", ("d", "/r"), ("e", "/t"))


@case(
    f"""select project_id, project_root, 'kept' as list from {PROJECTS} union all select project_id, project_root, case when project_root in (select project_root from {PROJECTS}) then 'rejected' else 'kept' end from {NEW_PROJECTS} union all select project_id, project_root, 'by_root' from {PROJECTS} where rtrim(project_root, '/') = '/s'"""
)
def project_registry(t):
    kept, rejected = services.registered(PROJECTS.df(t.spark), NEW_PROJECTS.df(t.spark))
    mark = lambda df, name: df.withColumn("list", F.lit(name))
    return mark(kept, "kept").unionByName(mark(rejected, "rejected")).unionByName(mark(services.by_root(PROJECTS.df(t.spark), "/s"), "by_root"))


@query(
    """select event_id // 11 as run, case when contains(event_type, 'i') then 'generated_test' else 'production' end as block, coalesce(value > 10, false) as ok, case when not coalesce(value > 10, false) then event_type || '_failed' end as code, count(*) as n from (select event_id, replace(event_type, 'i', 'generated_test') as x, event_type, value from events) group by all"""
)
def check_blocks(t):
    """Raw checks as blocks with issues: events as checks."""
    checks = t("events").select(F.expr("event_id div 11").alias("run_id"), F.expr("if(contains(event_type, 'i'), concat(event_type, '@generated_test'), event_type)").alias("name"), (F.col("value") > 10).alias("ok"), F.lit("").alias("output"))
    out = services.checks_to_blocks(checks)
    return out.select(F.col("run_id").alias("run"), "block", "ok", F.regexp_replace("code", "@generated_test", "").alias("code")).groupBy("run", "block", "ok", "code").agg(F.count("*").alias("n"))


@query(
    """select o_custkey, o_orderkey from orders where o_orderstatus = 'F' and o_totalprice >= 60000 qualify row_number() over (partition by o_custkey order by o_orderkey) = 1"""
)
def import_candidates(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("pos"), F.expr("if(o_orderstatus = 'F', 'import_change', 'other')").alias("change_kind"), (F.col("o_totalprice") / 100000).alias("confidence"))
    return services.import_change_candidate(rows, ["o_custkey"]).select("o_custkey", "o_orderkey")


# --- sessions, targets and payloads ----------------------------------------------

CHOSEN = Literal(
    "session_id string, selected_target string, recommended_target string, requested_operation string, insert_scope string, thin boolean, target string, operation string, scope string",
    ("s1", None, "m.a", "replace_symbol", None, False, "m.a", None, None), ("s2", " ", "m.a", "replace_symbol", "module_body", None, "m.b", "insert_after_symbol", "junk"), ("s3", "m.c", "m.a", "replace_symbol", None, True, "m.c", "", "class_body"), ("s4", None, None, "replace_symbol", None, False, "m.z", None, None), ("s5", None, None, "x", None, False, "", None, None),
)


@case(
    f"""select session_id, target as selected_target, coalesce(nullif(operation, ''), requested_operation) as requested_operation, coalesce(case when scope in ('module_body', 'class_body') then scope end, insert_scope) as insert_scope, case when coalesce(thin, false) then 'needs_user_decision' else 'target_selected' end as status,
    nullif(trim(target), '') is distinct from coalesce(nullif(trim(selected_target), ''), nullif(trim(recommended_target), '')) as selection_changed, coalesce(nullif(trim(selected_target), ''), nullif(trim(recommended_target), '')) as resolved,
    case when nullif(trim(selected_target), '') is not null then 'session_selected' when nullif(trim(recommended_target), '') is not null then 'session_recommended' end as source, case when coalesce(nullif(trim(selected_target), ''), nullif(trim(recommended_target), '')) is null then 'no target given and none recommended' end as error from {CHOSEN}"""
)
def session_targets(t):
    """Users' choices of targets, and what a run without one takes."""
    rows = CHOSEN.df(t.spark)
    own = ["session_id", "selected_target", "recommended_target", "requested_operation", "insert_scope", "thin"]
    chosen = services.selected_targets(rows.select(*own), rows.select("session_id", "target", "operation", "scope"))
    taken = rows.select("session_id", services.resolved_target(F.lit("").cast("string"), F.col("selected_target"), F.col("recommended_target")).alias("r"))
    return chosen.join(taken.select("session_id", F.col("r.target").alias("resolved"), F.col("r.source").alias("source"), F.col("r.error").alias("error")), "session_id")


MADE = Literal(
    "run_id string, changed array<string>, parent string, target string, kind string, scope string, file string, code string",
    ("i1", ["m.A.__init__", "m.A.go", "m.A.go.x", "m.B"], "m.A", "m.A", "method", "class_body", "m.py", ""), ("i2", ["m.A.__init__"], "m.A", "m.A", "method", "class_body", "m.py", "def go(self):\n    pass"), ("i3", ["m.x.y"], None, "m.f", "function", "module_body", "m.py", "x = 1\n\nasync def late():\n    pass"),
    ("i4", [], "", "m.A", "method", "class_body", "m.py", "def go(self): ..."), ("i5", None, None, "top", None, None, "a/b.py", "class New:\n    pass"), ("i6", [], None, "top", None, None, None, "nothing"), ("i7", ["m.g", "m.h"], None, "m.f", "function", "module_body", "m.py", None),
)
_up = "case when contains(coalesce(target, ''), '.') then regexp_replace(target, '\\.[^.]+$', '') end"


@case(
    f"""with p as (select *, coalesce(nullif(trim(parent), ''), case when scope = 'class_body' then nullif(trim(target), '') else {_up} end) as p from {MADE}),
    b as (select *, case when p is null then {_none} else list_filter(coalesce(changed, {_none}), lambda x: starts_with(x, p || '.') and not contains(substring(x, length(p) + 2), '.')) end as below from p),
    k as (select *, case when kind = 'method' and len(list_filter(below, lambda x: not ends_with(x, '.__init__'))) > 0 then list_filter(below, lambda x: not ends_with(x, '.__init__')) else below end as kept, nullif(regexp_extract(coalesce(code, ''), '(?m)^(?:async def|def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') as first,
      coalesce(p, case when ends_with(file, '.py') then replace(regexp_replace(file, '\\.py$', ''), '/', '.') else {_up} end) as prefix from b)
    select run_id, array_to_string(case when len(kept) > 0 then kept when first is null then {_none} when prefix is null then [first] else [prefix || '.' || first] end, ',') as symbols from k"""
)
def inserted_symbols(t):
    return services.inserted_symbols(MADE.df(t.spark)).select("run_id", F.array_join("symbols", ",").alias("symbols"))


REPORTS = Literal("run_id string, verdict string, generated_only boolean, paths array<string>", ("a", "verification_failed", True, ["t.py"]), ("b", "verification_failed", False, ["t.py"]), ("c", "generated_test_verification_failed", None, []), ("d", "ready_for_merge_review", False, []))


@case(
    f"""select run_id, case when coalesce(generated_only, false) then 'generated_test_verification_failed' else verdict end as verdict, not coalesce(generated_only, false) and verdict = 'verification_failed' as production_failed, coalesce(generated_only, false) or verdict = 'generated_test_verification_failed' as generated_test_failed,
    coalesce(generated_only, false) as runtime_only, case when coalesce(generated_only, false) then array_to_string(paths, ',') else '' end as excluded from {REPORTS}"""
)
def reclassified_reports(t):
    return services.reclassified(REPORTS.df(t.spark)).select("run_id", "verdict", "production_failed", "generated_test_failed", "runtime_only", F.array_join("excluded_files", ",").alias("excluded"))


CHANGES = Literal("id int, review boolean, target string, sure double, codes array<string>, import_change boolean, score double", (1, False, "m.a", 0.9, ["w"], True, 4.0), (2, None, "m.a", 0.9, None, False, 12.0), (3, True, None, 0.1, [], None, 0.0)).over("orders", "o_orderkey", score="cast(k.o_orderkey % 17 as double)")


@query(
    f"""select id, coalesce(review, false) or coalesce(import_change, false) as review, case when not coalesce(import_change, false) then target end as target, case when coalesce(import_change, false) then 0.0 else sure end as sure, case when import_change then 'import_change' end as role,
    array_to_string(case when import_change then list_append(coalesce(codes, {_none}), '{analysis.NON_SYMBOL_CODE}') else coalesce(codes, {_none}) end, ',') as codes, case when import_change then target end as previous_target, least(1.0, score / 10.0) as confidence, 'средняя' as category from {CHANGES}"""
)
def import_reviews(t):
    """Changes of imports lose their target; symbols that are candidates without a search."""
    c = F.col
    rows = CHANGES.of(t).select("id", analysis.non_symbol_change(c("review"), c("target"), c("sure"), c("codes"), c("import_change")).alias("r"), analysis.symbol_candidate(c("score")).alias("s"))
    return rows.select("id", "r.review", "r.target", "r.sure", "r.role", F.array_join("r.codes", ",").alias("codes"), "r.previous_target", "s.confidence", "s.category")


BATCH = Literal("target string, pos int", ("tests.t", 2), ("tests.t.C.m", 0), ("tests.t.C.m ", 1), ("no.such", 3), (" ", 4), ("tests.u.test_x", 5), ("tests.u.test_y", 6))
BATCH_FILES = Literal("file_path string", ("tests/t.py",), ("tests/u.py",))


@case(
    f"""with t as (select trim(target) as target, pos from {BATCH} where trim(target) <> ''), p as (select distinct target, string_split(target, '.') as p from t), e as (select target, n, array_to_string(p[1:n], '/') || '.py' as path, array_to_string(p[n + 1:], '::') as node from p, (select unnest(range(1, 9)) as n) where n <= len(p)),
    h as (select e.*, node = '' or (path, node) in (select (path, node) from {TEST_NODES}) as has from e where path in (select file_path from {BATCH_FILES})), b as (select * from h qualify row_number() over (partition by target order by has desc, n desc) = 1),
    r as (select t.*, case when has then path || case when node <> '' then '::' || node else '' end else path end as path, case when path is null then 'unresolved' when has then 'resolved' else 'fallback_file' end as status from t left join b using (target)),
    f as (select path, min(pos) as first from r where path is not null group by 1), k as (select * from f where path not in (select string_split(path, '::')[1] from f where contains(path, '::')))
    select target, r.path, status, pos, case when pos = k.first then pos end as run_pos from r left join k on r.path = k.path"""
)
def test_batch(t):
    """Test targets as one run takes them."""
    return workspace.target_batch(BATCH.df(t.spark), BATCH_FILES.df(t.spark), TEST_NODES.df(t.spark))


@query(
    """with s as (select conv_id, role as step, length(text) as prompt_tokens, turn as output_tokens, length(role) as prompt_chars from conversations)
    select conv_id, count(distinct step) as calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(output_tokens)::bigint as output_tokens, sum(prompt_chars)::bigint as prompt_chars, (sum(prompt_tokens) + sum(output_tokens))::bigint as total_tokens from s group by 1"""
)
def analysis_usage(t):
    steps = t("conversations").select("conv_id", F.col("role").alias("step"), F.length("text").alias("prompt_tokens"), F.col("turn").alias("output_tokens"), F.length("role").alias("prompt_chars"))
    return usage.analysis_usage(steps, ["conv_id"])


@query(
    f"""select n_nationkey as id, coalesce(case when n_nationkey % 3 = 0 then 'new' end, 't' || n_nationkey) as title, 'd' as descr, case when n_nationkey % 2 = 0 then 'x' end as extra, array_to_string(list_filter(['a', case when n_nationkey % 2 = 0 then 'b' else 'a' end, 'b'], lambda x, i: list_position(['a', case when n_nationkey % 2 = 0 then 'b' else 'a' end, 'b'], x) = i), ',') as targets,
    concat_ws(' ', n_name, case when n_nationkey % 2 = 0 then 'doc' end) as summary from nation"""
)
def allowed_fields(t):
    """Allowed keys over an entry's own, unions of test targets, target summaries."""
    n = t("nation")
    target = F.create_map(F.lit("title"), F.expr("concat('t', n_nationkey)"), F.lit("descr"), F.lit("d"))
    source = F.create_map(F.lit("title"), F.expr("if(n_nationkey % 3 = 0, 'new', ' ')"), F.lit("extra"), F.expr("if(n_nationkey % 2 = 0, 'x', null)"), F.lit("forbidden"), F.lit("z"))
    merged = knowledge.allowed_merge(target, source, ("title", "extra"))
    both = workspace.all_targets(F.array(F.lit("a"), F.expr("if(n_nationkey % 2 = 0, 'b', ' ')")), F.array(F.lit("b"), F.lit("a")))
    summary = sources.target_summary(F.col("n_name"), F.expr("if(n_nationkey % 2 = 0, 'doc', '')"), F.lit(None).cast("string"), F.lit(" "))
    return n.select(F.col("n_nationkey").alias("id"), merged["title"].alias("title"), merged["descr"].alias("descr"), merged["extra"].alias("extra"), F.array_join(both, ",").alias("targets"), summary.alias("summary"))
