"""The engine's operators over the driver tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.tables import shared_folder
from ..operators import budget, diff, graph, knowledge, postings, search, suggest, usage, vector_index
from ..sources import code
from ..sources import documents as sources
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

PATTERN = text.TERM_PATTERN
FOLDED = "replace(translate(lower({c}), 'ёς', 'еσ'), 'ß', 'ss')"


def folded(c: str) -> str:
    return FOLDED.format(c=c)


def points_sql(terms: list[tuple[str, str]], fields: dict[str, int], plain: str = "f_", bags: str = "t_") -> str:
    """Sum over terms of the best field's points, as the engine scores them."""
    each = []
    for term, root in terms:
        best = ", ".join(
            f"case when list_contains({bags}{f}, '{term}') then {w} when contains({plain}{f}, '{term}') then {w} * 75 // 100 when contains({plain}{f}, '{root}') then {w} * 55 // 100 else 0 end" for f, w in fields.items()
        )
        each.append(f"greatest({best})")
    return " + ".join(each)


SEARCH_TEXT = "mail the thing ration anonymous wider stories"
# terms of SEARCH_TEXT; none of the suffixes is Latin, so a term is its own stem
SEARCH_TERMS = [(t, t) for t in sorted(set(SEARCH_TEXT.split()))]
SEARCH_FIELDS = {"text": 320, "source": 140, "lang": 80}
_prepared = ", ".join(f"{folded(f'coalesce({f}, {chr(39) * 2})')} as f_{f}, regexp_extract_all({folded(f'coalesce({f}, {chr(39) * 2})')}, '{PATTERN}') as t_{f}" for f in SEARCH_FIELDS)


@query(
    f"""with d as (select documents.*, {_prepared}, quality from documents left join labels using (doc_id)),
    s as (select doc_id, quality, ({points_sql(SEARCH_TERMS, SEARCH_FIELDS)}) as p from d)
    select doc_id, quality, cast(p / 100.0 as decimal(12, 2)) as score from s where p > 0 order by p desc, doc_id limit 20"""
)
def weighted_search(t):
    docs = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    found = search.weighted_search(docs, SEARCH_TEXT, {f: F.col(f) for f in SEARCH_FIELDS}, SEARCH_FIELDS, ["doc_id"], 20)
    return found.select("doc_id", "quality", "score")


@query(
    f"""select token, count(*) as n, count(distinct doc_id) as docs
    from (select doc_id, unnest(regexp_extract_all({folded('text')}, '{PATTERN}')) as token from documents) group by token"""
)
def text_tokens(t):
    """Every token, those that occur once among them."""
    each = t("documents").select("doc_id", F.explode(text.tokens(text.normalise("text"))).alias("token"))
    # (token, document) first: the count of documents is then a plain sum
    return each.groupBy("token", "doc_id").count().groupBy("token").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))


#: Words of every suffix, long enough and one letter short, and of none.
STEM_WORDS = [f"{root}{suffix}" for suffix in dict.fromkeys(text.SUFFIXES) for root in ("слов", "сло", "Ёлк", "word")] + ["нет", "уведомление", "ТЕКСТАМИ", "straße", "x_y"]
_stem_words = "select unnest([" + ", ".join(f"'{w}'" for w in STEM_WORDS) + "]) as text"


@query(
    f"""with w as (select distinct unnest(regexp_extract_all({folded("text")}, '{PATTERN}')) as term from (select text from documents union all {_stem_words}))
    select term, {text.stem_sql('term')} as stem, length(term) >= 4 as long_term, case when length(term) >= 4 then list_sort(list_distinct([term, {text.stem_sql('term')}])) else [term] end as terms from w
    where term not in ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})"""
)
def term_expand(t):
    """All words of the documents and words of every suffix of the stem rule."""
    every = t("documents").select("text").unionByName(t.spark.createDataFrame([(w,) for w in STEM_WORDS], "text string"))
    words = every.select(F.explode(text.tokens(text.normalise("text"))).alias("term")).distinct().where(~F.col("term").isin(*text.STOP_WORDS))
    return words.select("term", text.stem("term").alias("stem"), (F.length("term") >= text.LEAST_STEM).alias("long_term"), text.query_terms("term").alias("terms"))


PART_FIELDS = {"p_name": 340, "p_type": 280, "p_brand": 100}
PART_QUERIES = ["blue steel", "small brass  ", "", "Brand promo", "blue steel", "green"]
_part = ", ".join(f"{folded(f)} as f_{f}, regexp_extract_all({folded(f)}, '{PATTERN}') as t_{f}" for f in PART_FIELDS)
_each_query = " union all ".join(
    f"select '{q}' as query, {i} as pos, p_partkey, ({points_sql([(w, w) for w in sorted(set(q.lower().split()))], PART_FIELDS)}) as p from d"
    for i, q in enumerate(dict.fromkeys(x.strip() for x in PART_QUERIES if x.strip()))
)


@query(
    f"""with d as (select p_partkey, {_part} from part), s as ({_each_query})
    select query, p_partkey, cast(p / 100.0 as decimal(12, 2)) as score, rank::int as rank from (
      select *, row_number() over (partition by query order by p desc, p_partkey) as rank from s where p > 0) where rank <= 5"""
)
def batch_search(t):
    parts = t("part")
    asked = parts.sparkSession.createDataFrame([(q, i) for i, q in enumerate(PART_QUERIES)], "query string, pos int")
    found = search.batch_search(parts, asked, {f: F.col(f) for f in PART_FIELDS}, PART_FIELDS, ["p_partkey"], 5)
    return found.select("query", "p_partkey", "score", "rank")


_stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: Scores of every document for every benchmark item, from words alone.
ITEM_SCORES = f"""q as (select trim(text) as query, min(item_id) as item_id from benchmark where trim(text) <> '' group by 1),
    w as (select item_id, unnest(list_distinct(regexp_extract_all({folded("query")}, '{PATTERN}'))) as term from q),
    k as (select * from w where term not in ({_stop})),
    t as (select distinct item_id, term from (select item_id, term from k union all select item_id, {text.stem_sql("term")} from k where length(term) >= {text.LEAST_STEM}) where term <> ''),
    r as (select distinct term, {text.stem_sql("term")} as root from t),
    e as (select doc_id, token, max(weight) as weight from (
      {" union all ".join(f"select doc_id, {w} as weight, unnest(list_distinct(regexp_extract_all({folded(f'coalesce({f}, {chr(39) * 2})')}, '{PATTERN}'))) as token from documents" for f, w in SEARCH_FIELDS.items())}) group by 1, 2),
    h as (select token, term, case when token = term then 100 when contains(token, term) then 75 else 55 end as m from (select distinct token from e) join r on contains(token, root)),
    b as (select doc_id, term, max(weight * m // 100) as points from e join h using (token) group by 1, 2),
    s as (select item_id, doc_id, sum(points) as p from b join t using (term) group by 1, 2)"""
ITEM_TOP = f"with {ITEM_SCORES} select item_id, doc_id, cast(p / 100.0 as decimal(12, 2)) as score, rank::int as rank from (select *, row_number() over (partition by item_id order by p desc, doc_id) as rank from s) where rank <= 5"


@query(ITEM_TOP)
def benchmark_search(t):
    """Benchmark items as queries over all documents."""
    asked = t("benchmark").select(F.col("text").alias("query"), F.col("item_id").alias("pos"))
    found = search.batch_search(t("documents"), asked, {f: F.col(f) for f in SEARCH_FIELDS}, SEARCH_FIELDS, ["doc_id"], 5)
    return found.select(F.col("pos").alias("item_id"), "doc_id", "score", "rank")


def _postings(t):
    """An index of all documents, in the shared folder."""
    index = postings.Postings(t.spark, f"{shared_folder(t.spark)}/{uuid.uuid4().hex}/index", {"doc_id": "long"}, SEARCH_FIELDS)
    index.build(t("documents"), {f: F.col(f) for f in SEARCH_FIELDS})
    return index


@query(
    f"""with d as (select documents.*, {_prepared}, quality from documents left join labels using (doc_id)),
    s as (select doc_id, quality, ({points_sql(SEARCH_TERMS, SEARCH_FIELDS)}) as p from d)
    select doc_id, quality, cast(p / 100.0 as decimal(12, 2)) as score from s where p > 0 order by p desc, doc_id limit 20"""
)
def indexed_search(t):
    """``weighted_search`` by postings: blocks that cannot reach the 20th
    score are not read."""
    found = _postings(t).search(t.spark.createDataFrame([(SEARCH_TEXT, 0)], "query string, pos int"), 20)
    return found.join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "quality", "score")


_cosine = "list_cosine_distance(v, q)"
_vectors = "select vec_id, label, embedding::double[] as v from embeddings"


@query(
    f"""with e as ({_vectors}), q as (select vec_id as query_id, v as q from e where vec_id % 100 = 0),
    s as (select query_id, label, max(1 / (1 + {_cosine})) as sim from e, q group by all)
    select query_id::bigint as query_id, label, round(sim, 6) as similarity, rank::int as rank from (
      select *, row_number() over (partition by query_id order by sim desc, label) as rank from s) where rank <= 5"""
)
def vector_topk(t):
    """Labels by their best vector, for every vector of an id divisible by 100."""
    vectors = t("embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.vector_topk(vectors, asked, 5, "label")
    return found.select("query_id", F.col("key").alias("label"), F.round("similarity", 6).alias("similarity"), "rank")


_nearest = f"""with e as ({_vectors}), q as (select vec_id as query_id, v as q from e where vec_id % 100 = 0),
    s as (select query_id, vec_id, 1 / (1 + {_cosine}) as sim from e, q)
    select query_id::bigint as query_id, vec_id::bigint as vec_id, round(sim, 6) as similarity, rank::int as rank from (
      select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s) where rank <= 10"""


@query(_nearest)
def clustered_topk(t):
    """The ten nearest vectors of every id divisible by 100, by lists."""
    vectors = t("embeddings")
    index = vector_index.VectorIndex(t.spark, f"{shared_folder(t.spark)}/{uuid.uuid4().hex}/vectors")
    index.build(vectors, "vec_id")
    found = index.search(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)
    return found.select("query_id", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query(None)
def name_suggestions(t):
    """Part names with a word cut and two joined, as references that were not
    found, against all part names. Ratios are beyond SQL; the tests hold them
    against all pairs."""
    parts = t("part").select("p_partkey", F.lower("p_name").alias("name"))
    refs = parts.where("p_partkey % 100 = 0").select(F.regexp_replace(F.regexp_replace("name", " [a-z]{2}", " "), "(?<=[a-z]) ", "_").alias("ref"))
    return suggest.close_names(refs, parts.select("name"))


@query(
    f"""with e as ({_vectors}), q as (select v as q from e where vec_id = 0), d as (select documents.*, {_prepared} from documents),
    s as (select doc_id, ({points_sql(SEARCH_TERMS, SEARCH_FIELDS)}) / 100.0 as lex, coalesce(1 / (1 + {_cosine}), 0) as sim
          from d left join (select vec_id, v, q from e, q) on doc_id = vec_id)
    select doc_id, round(lex + 4 * sim, 4) as score from s where lex + sim > 0 order by lex + 4 * sim desc, doc_id limit 20"""
)
def hybrid_topk(t):
    vectors = t("embeddings")
    one = vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    sims = vectors.crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("doc_id"), scoring.similarity(scoring.cosine_distance(F.col("embedding").cast("array<double>"), F.col("q"))).alias("similarity"))
    found = search.hybrid_search(t("documents"), SEARCH_TEXT, {f: F.col(f) for f in SEARCH_FIELDS}, SEARCH_FIELDS, sims, "doc_id", 20)
    return found.select("doc_id", F.round("score", 4).alias("score"))


@query(
    f"""with d as (select p_partkey, {_part} from part), s as ({_each_query}),
    u as (select p_partkey, max(p) as p from s where p > 0 group by 1)
    select p_partkey, cast(p / 100.0 as decimal(12, 2)) as score from u order by p desc, p_partkey limit 12"""
)
def recall_union(t):
    parts = t("part")
    asked = parts.sparkSession.createDataFrame([(q, i) for i, q in enumerate(PART_QUERIES)], "query string, pos int")
    found = search.batch_search(parts, asked, {f: F.col(f) for f in PART_FIELDS}, PART_FIELDS, ["p_partkey"], 12).withColumnRenamed("pos", "query_pos")
    return search.union_best(found, "p_partkey", 12).select("p_partkey", "score")


@query(
    """with a as (select doc_id, sha256(text) as h from documents where doc_id % 5 <> 0),
    b as (select doc_id, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as h from documents where doc_id % 11 <> 0)
    select case when a.doc_id is null then 'new' when b.doc_id is null then 'deleted' when a.h = b.h then 'unchanged' else 'changed' end as status, count(*) as n
    from a full join b on a.doc_id = b.doc_id group by 1"""
)
def inc_index_status(t):
    docs = t("documents")
    known = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    now = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return diff.status_counts(diff.status(known, now, ["doc_id"], "h"))


@query(
    """with a as (select doc_id, source, n_chars from documents where doc_id % 5 <> 0),
    b as (select doc_id, source, case when doc_id % 7 = 0 then null else n_chars end as n_chars from documents where doc_id % 11 <> 0)
    select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' else 'changed_content' end as change
    from a full join b on a.doc_id = b.doc_id
    where a.doc_id is null or b.doc_id is null or a.source is distinct from b.source or a.n_chars is distinct from b.n_chars"""
)
def doc_set_diff(t):
    docs = t("documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", "source", "n_chars")
    new = docs.where("doc_id % 11 <> 0").select("doc_id", "source", F.expr("if(doc_id % 7 = 0, null, n_chars)").alias("n_chars"))
    return diff.set_diff(old, new, ["doc_id"])


@query(
    """with c as (select 'src/' || doc_id as p, doc_id from documents),
    b as (select doc_id, quality = 1 as was, sha256(toxic::varchar) as h from labels),
    n as (select doc_id, sha256((n_chars % 2)::varchar) as h from documents where doc_id % 3 <> 0)
    select p as file_path, case when b.doc_id is null then 'unprotected' when was and n.doc_id is null then 'deleted_after_baseline'
      when not was and n.doc_id is not null then 'created_after_baseline' when was and b.h is distinct from n.h then 'changed_after_baseline' else 'ok' end as state
    from c left join b using (doc_id) left join n using (doc_id)"""
)
def base_guard(t):
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("file_path")
    docs, labels = t("documents"), t("labels")
    baseline = labels.select(path, (F.col("quality") == 1).alias("exists"), F.sha2(F.col("toxic").cast("string"), 256).alias("sha256"))
    now = docs.where("doc_id % 3 <> 0").select(path, F.sha2((F.col("n_chars") % 2).cast("string"), 256).alias("sha256"))
    return diff.base_guard(docs.select(F.concat(F.lit("./src/"), F.col("doc_id").cast("string")).alias("file_path")), baseline, now)


@query(
    """select event_id, user_id, event_type, value from events
    qualify row_number() over (partition by user_id, event_type, cast(ts as date) order by ts, event_id) = 1"""
)
def relation_dedupe(t):
    rows = t("events").withColumn("day", F.to_date("ts"))
    return diff.first_wins(rows, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query(
    """select user_id, event_type, event_id, value from events
    qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"""
)
def upsert_latest(t):
    """The later half of the event types' rows comes as an update."""
    rows = t("events").select("user_id", "event_type", "ts", "event_id", "value")
    cut = rows.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("_cut"))
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    marked = rows.crossJoin(F.broadcast(cut))  # one row
    old, new = (marked.where(c).drop("_cut") for c in ("ts < _cut", "ts >= _cut or ts is null"))
    return diff.upserted(diff.latest(old, keys, order), diff.latest(new, keys, order), keys).select("user_id", "event_type", "event_id", "value")


@query(
    """select o_orderkey, o_custkey, o_totalprice from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)
    union all select -c_custkey, c_custkey, c_acctbal from customer where c_nationkey = 3"""
)
def replace_by_file(t):
    old, cust = t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), t("customer").where("c_nationkey = 3")
    new = cust.select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"))
    return diff.replaced(old, new, new, ["o_custkey"])


@query(
    """select o_custkey as target, count(*) filter (l_returnflag = 'A') as "A", count(*) filter (l_returnflag = 'N') as "N", count(*) filter (l_returnflag = 'R') as "R"
    from lineitem join orders on l_orderkey = o_orderkey group by 1"""
)
def inbound_counts(t):
    # lines of an order are counted before they meet it: the join moves one row an order
    lines = graph.edge_counts(t("lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])
    edges = lines.join(t("orders").select("o_orderkey", F.col("o_custkey").alias("target")), F.col("l_orderkey") == F.col("o_orderkey"))
    return edges.groupBy("target").agg(*[F.sum(k).alias(k) for k in "ANR"])


@query(
    """select l_linestatus, count(*) filter (l_returnflag = 'A') as high, count(*) filter (l_returnflag = 'N') as medium, count(*) filter (l_returnflag = 'X') as low
    from lineitem group by 1"""
)
def confidence_hist(t):
    level = F.create_map(*[F.lit(x) for x in ("A", "high", "N", "medium", "X", "low")])
    rows = t("lineitem").select("l_linestatus", F.element_at(level, F.col("l_returnflag")).alias("confidence"))
    return graph.histogram(rows, "confidence", ["high", "medium", "low"], ["l_linestatus"])


_names = "select 'nation.' || n_name as qualname, n_name as name from nation union all select 'region.' || r_name, r_name from region union all select 'dup.' || r_name, r_name from region"


@query(
    f"""with s as ({_names}), u as (select name, min(qualname) as qualname from s group by 1 having count(*) = 1),
    e as (select c_custkey, 'nation.' || n_name as target_qualname, r_name as target_ref from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey % 2 = 0
          union all select c_custkey, 'gone.' || n_name, case when c_custkey % 3 = 0 then r_name else n_name end from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey % 2 = 1)
    select c_custkey, coalesce(f.qualname, u.qualname) as resolved, case when f.qualname is not null then 'exact' when u.qualname is not null then 'short_name' else 'unresolved' end as how
    from e left join s f on e.target_qualname = f.qualname left join u on e.target_ref = u.name"""
)
def resolve_cascade(t):
    nation, region, cust = t("nation"), t("region"), t("customer")
    named = lambda df, kind, c: df.select(F.concat(F.lit(kind), F.col(c)).alias("qualname"), F.col(c).alias("name"))
    symbols = named(nation, "nation.", "n_name").unionByName(named(region, "region.", "r_name")).unionByName(named(region, "dup.", "r_name"))
    base = cust.join(nation, cust.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    even = F.col("c_custkey") % 2 == 0
    edges = base.select(
        "c_custkey", F.concat(F.when(even, "nation.").otherwise("gone."), "n_name").alias("target_qualname"), F.when(even | (F.col("c_custkey") % 3 == 0), F.col("r_name")).otherwise(F.col("n_name")).alias("target_ref")
    )
    return graph.resolved(edges, symbols).select("c_custkey", "resolved", "how")


_edges = """select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier
    union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'o' || o_orderkey, 'c' || o_custkey from orders"""
_walk = "with recursive e as ({edges}), w as (select 'r' || r_regionkey as root, 'r' || r_regionkey as node, 0 as hops from region union select root, src, hops + 1 from w join e on node = dst where hops < {depth})"


def _graph(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("nation", "n", "n_nationkey", "r", "n_regionkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")]
    out = None
    for name, a, x, b, y in parts:
        edges = t(name).select(key(a, x).alias("src"), key(b, y).alias("dst"))
        out = edges if out is None else out.unionByName(edges)
    return out, t("region").select(key("r", "r_regionkey").alias("root"), key("r", "r_regionkey").alias("node"))


@query(_walk.format(edges=_edges, depth=3) + " select root, node, min(hops)::int as hops from w group by 1, 2")
def bfs_reach(t):
    edges, start = _graph(t)
    return graph.reach(edges, start, 3)


@query(
    f"""with recursive e as ({_edges}), r as (select dst as root from e union select src from e where src like 'c%'), w as (select root, root as node, 0 as hops from r
    union select root, src, hops + 1 from w join e on e.dst = w.node where hops < 2) select root, node, min(hops)::int as hops from w group by 1, 2"""
)
def many_roots(t):
    """Every region, nation and customer as a root of its own."""
    edges, _ = _graph(t)
    roots = edges.select(F.col("dst").alias("root")).union(edges.where("src like 'c%'").select("src")).distinct()
    return graph.reach(edges, roots.select("root", F.col("root").alias("node")), 2)


#: Characters of a request, and what is done to its turns, in order.
REQUEST_CHARS = 1500
REQUEST_STEPS = [budget.Halve("fewer turns", "turns", 4), budget.Clip("shorter texts", "turns", 120), budget.Drop("no roles", "turns", "role"), budget.Halve("one turn", "turns", 1)]


def _total(sizes: str, n: str) -> str:
    return f"(13 + coalesce(list_sum({sizes}[1:{n}]), 0) + 2 * greatest({n} - 1, 0))"


def _halvings(sizes: str, n: str, least: int) -> str:
    """Halvings of the first ``n`` items until they fit, or no more change."""
    kept = f"greatest({n} // (2 ** j)::bigint, least({n}, {least}))"
    return f"case when {_total(sizes, n)} <= {REQUEST_CHARS} then 0 else coalesce(list_filter(range(0, 32), lambda j: {_total(sizes, kept)} <= {REQUEST_CHARS})[1], list_filter(range(0, 32), lambda j: {kept} = least({n}, {least}))[1]) end"


_turn = "10 + length(to_json({text})::varchar) + 8"
_with_role = f"{_turn} + 10 + length(to_json(role)::varchar) - 8"


@query(
    f"""with c as (select conv_id, count(*) as n, list({_with_role.format(text='text')} order by turn, role, text) as full_, list({_with_role.format(text='text[1:120]')} order by turn, role, text) as short_,
      list(2 + 8 + length(to_json(text[1:120])::varchar) order by turn, role, text) as bare from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations) group by 1),
    a as (select *, {_halvings('full_', 'n', 4)} as h1 from c), b as (select *, greatest(n // (2 ** h1)::bigint, least(n, 4)) as n1 from a),
    d as (select *, {_total('full_', 'n1')} as s1, {_total('short_', 'n1')} as s2, {_total('bare', 'n1')} as s3 from b),
    e as (select *, s1 > {REQUEST_CHARS} as clip, s1 > {REQUEST_CHARS} and full_[1:n1] <> short_[1:n1] as clipped, case when s1 > {REQUEST_CHARS} then s2 else s1 end > {REQUEST_CHARS} as dropped from d),
    f as (select *, case when dropped then {_halvings('bare', 'n1', 1)} else 0 end as h2 from e),
    g as (select *, case when dropped then greatest(n1 // (2 ** h2)::bigint, least(n1, 1)) else n1 end as n2 from f)
    select conv_id, n2::int as turns, (case when dropped then {_total('bare', 'n2')} when clip then s2 else s1 end)::bigint as size,
    array_to_string(list_concat(list_concat(list_transform(range(0, h1), lambda x: 'fewer turns'), case when clipped then ['shorter texts'] else [] end), list_concat(case when dropped then ['no roles'] else [] end, list_transform(range(0, h2), lambda x: 'one turn'))), ',') as steps from g"""
)
def budgeted_requests(t):
    """Conversations as requests of a bounded size, with the steps taken."""
    turns = t("conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    listed = listed.withColumn("turns", F.transform("turns", lambda x: F.create_map(F.lit("role"), x.role, F.lit("text"), x.text)))
    out = budget.reduced(listed, F.lit(len('{"turns": []}')), ["turns"], REQUEST_STEPS, REQUEST_CHARS)
    return out.select("conv_id", F.size("turns").alias("turns"), "size", F.array_join("steps", ",").alias("steps"))


@query(_walk.format(edges=_edges, depth=2) + " select root as target, count(*) filter (hops = 1) as direct, count(*) filter (hops = 2) as indirect, count(*) filter (node like 's%') as tests from (select root, node, min(hops) as hops from w group by 1, 2) group by 1")
def impact_2hop(t):
    edges, start = _graph(t)
    found = graph.reach(edges, start, 2)
    return found.groupBy(F.col("root").alias("target")).agg(F.count_if(F.col("hops") == 1).alias("direct"), F.count_if(F.col("hops") == 2).alias("indirect"), F.count_if(F.col("node").startswith("s")).alias("tests"))


@query(
    """select o_custkey, o_orderkey, rank::int as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 8"""
)
def topn_per_group(t):
    return search.top_per_key(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 8).select("o_custkey", "o_orderkey", "rank")


@query(
    """with o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders),
    l as (select l_orderkey, count(*) as lines from lineitem group by 1)
    select c_custkey, count(o_orderkey) as orders, string_agg(o_orderkey::varchar || ':' || coalesce(lines, 0)::varchar, ',' order by o_orderdate, o_orderkey) as pack
    from customer left join (select * from o where rn <= 8) o on c_custkey = o_custkey left join l on o_orderkey = l_orderkey group by 1"""
)
def context_pack(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    top = search.top_per_key(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 8)
    parts = top.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    item = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.coalesce("lines", F.lit(0)).cast("string"))
    packs = parts.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", item.alias("item")))).alias("items"))
    out = t("customer").select("c_custkey").join(packs, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("orders"), F.array_join(F.transform("items", lambda x: x.item), ",").alias("pack"))


@query(
    """with w as (select distinct unnest(string_split(lower(p_name), ' ')) as name from part), s as (select p_partkey, lower(p_name || ' ' || p_type) as name from part)
    select w.name as qualname, 'p' || p_partkey as test from w join s on contains(s.name, w.name)"""
)
def substring_tests(t):
    """Words of part names as targets, parts as tests: a stated set against
    all rows."""
    part = t("part")
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).distinct()
    targets = words.select(F.col("name").alias("qualname"), "name", F.lit("m.none").alias("module_name"))
    tests = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("qualname"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.lit("function").alias("kind"), F.lit("tests/parts.py").alias("file_path"))
    return graph.file_based_tests(tests, targets)


_links = "select doc_id, 'R' || (doc_id % 17) as req_id, (doc_id % 5)::int as pos, 'direct' as origin from labels where quality = 1 union all select doc_id, 'R' || (n_chars % 13), (n_chars % 4)::int, 'linked' from documents"


@query(
    f"""with l as ({_links}), b as (select doc_id, req_id, min((case when origin = 'direct' then 0 else 1 end) * 100 + pos) as o from l group by 1, 2),
    r as (select doc_id, min(pos) as rank from l where origin = 'linked' group by 1)
    select doc_id, req_id, (row_number() over (partition by doc_id order by o, req_id) - 1)::int as ord, rank from b left join r using (doc_id)"""
)
def req_links(t):
    key = F.col("doc_id").cast("long").alias("qualname")
    direct = t("labels").where("quality = 1").select(F.expr("concat('R', doc_id % 17)").alias("req_id"), key, F.expr("cast(doc_id % 5 as int)").alias("pos"), F.lit("direct").alias("origin"))
    linked = t("documents").select(F.expr("concat('R', n_chars % 13)").alias("req_id"), key, F.expr("cast(n_chars % 4 as int)").alias("pos"), F.lit("linked").alias("origin"))
    links = direct.unionByName(linked)
    out = knowledge.requirement_links(links).join(knowledge.requirement_ranks(links), "qualname", "left")
    return out.select(F.col("qualname").alias("doc_id"), "req_id", "ord", F.col("requirement_rank").alias("rank"))


@query("""select r_name as layer, string_agg(distinct n_name, ',' order by n_name) as modules, count(distinct n_name) as n from nation join region on n_regionkey = r_regionkey group by 1""")
def layer_groups(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return knowledge.layer_groups(rows, "r_name", "n_name").select("layer", F.array_join("modules", ",").alias("modules"), "n")


_urls = "select page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') as p from pages"


@query(
    f"""with u as ({_urls}), x as (select page_id, unnest(range(1, len(p) + 1)) as n, p from u), y as (select page_id, n, array_to_string(p[1:n], '/') as prefix from x),
    k as (select prefix from y group by 1 having count(distinct page_id) > 1)
    select pages.page_id, arg_max(prefix, n) as nearest from pages left join (select * from y join k using (prefix)) z on pages.page_id = z.page_id group by 1"""
)
def longest_prefix(t):
    """The longest path prefix that a page shares with another page."""
    pages = t("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    parts = pages.withColumn("p", F.split("path", "/"))
    prefixes = parts.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("prefix"))
    known = prefixes.distinct().groupBy("prefix").count().where("count > 1").select("prefix")
    return graph.longest_prefix(pages, "path", known, "prefix", "/", "/").select("page_id", "nearest")


@query("""select event_id, coalesce(json_extract_string(props, '$.k'), '') as k, coalesce(try_cast(json_extract_string(props, '$.v') as double), 0) as v from events""")
def json_field(t):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), text.safe_double(F.get_json_object("props", "$.v")).alias("v"))


@query(
    """select coalesce(user_id % 10, 0)::int as run_id, case when grouping(event_type) = 1 then 'total' else event_type end as step, count(*) as calls, round(sum(coalesce(value, 0)), 4) as total
    from events group by rollup (user_id % 10, event_type) having grouping(user_id % 10) = 0"""
)
def usage_rollup(t):
    rows = t("events").select(F.expr("cast(user_id % 10 as int)").alias("run_id"), F.col("event_type").alias("step"), F.lit(1).alias("calls"), F.col("value").alias("total"))
    out = usage.usage_rollup(rows, metrics=["calls", "total"])
    return out.select(F.coalesce("run_id", F.lit(0)).alias("run_id"), "step", F.col("calls").cast("long").alias("calls"), F.round("total", 4).alias("total"))


@query("""select conv_id as run_id, sum(length(text))::bigint as duration_ms, count(*) as steps, count(*) filter (role = 'system') as failed from conversations group by 1""")
def run_duration(t):
    steps = t("conversations").select(F.col("conv_id").alias("run_id"), F.length("text").alias("duration_ms"), F.when(F.col("role") == "system", "failed").otherwise("ok").alias("status"))
    return usage.run_durations(steps)


@query(
    f"""with d as (select md5(text) as text_md5, doc_id, count(*) over (partition by text) as n from documents)
    select text_md5, n, doc_id // {usage.LINES} as part, string_agg(doc_id::varchar, ',' order by doc_id) as lines from d where n > 1 group by all"""
)
def dup_definitions(t):
    rows = t("documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return usage.duplicates(rows, ["text_md5"], "doc_id").select("text_md5", "n", "part", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query(
    """select source, case when bool_or(quality = 0 and lang = 'en') then 'verification_failed' when bool_or(quality = 0 and lang <> 'en') then 'generated_test_verification_failed' else 'ready_for_merge_review' end as verdict
    from documents join labels using (doc_id) group by 1"""
)
def verdict_fold(t):
    rows = t("documents").join(t("labels"), "doc_id")
    blocks = rows.select("source", F.when(F.col("lang") == "en", "production").otherwise("generated_test").alias("block"), (F.col("quality") == 1).alias("ok"))
    return usage.verdict(blocks, ["source"])


@query(
    """select source, lang, case when bool_or(quality = 0 and lang = 'en') then 'verification_failed' when bool_or(quality = 0 and lang <> 'en') then 'generated_test_verification_failed' else 'ready_for_merge_review' end as verdict
    from documents join labels using (doc_id) group by 1, 2"""
)
def verdict_fold_all(t):
    """All labelled documents, by source and language."""
    rows = t("documents").join(t("labels"), "doc_id")
    blocks = rows.select("source", "lang", F.when(F.col("lang") == "en", "production").otherwise("generated_test").alias("block"), (F.col("quality") == 1).alias("ok"))
    return usage.verdict(blocks, ["source", "lang"])


@query(
    f"""select distinct token from (select unnest(regexp_extract_all({folded('text')}, '{PATTERN}')) as token from benchmark)
    where token not in (select unnest(regexp_extract_all({folded('text')}, '{PATTERN}')) from documents)"""
)
def unresolved_names(t):
    names = lambda df: df.select(F.explode(text.tokens(text.normalise("text"))).alias("token")).distinct()
    return graph.unresolved(names(t("benchmark")), names(t("documents")), "token")


@query(
    f"""with w as (select conv_id, turn, list_distinct(regexp_extract_all({folded('text')}, '{PATTERN}')) as s from conversations),
    p as (select a.conv_id, a.turn, a.s as x, b.s as y from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
    select conv_id, turn, round(case when least(len(x), len(y)) > 0 then len(list_intersect(x, y)) / least(len(x), len(y)) else 0 end, 6) as overlap from p"""
)
def overlap_coeff(t):
    bags = t("conversations").select("conv_id", "turn", F.array_distinct(text.tokens(text.normalise("text"))).alias("s"))
    nxt = bags.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("y"))
    return bags.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(knowledge.overlap(F.col("s"), F.col("y")), 6).alias("overlap"))


@query(
    r"""select page_id, case when length(html) <= 120 then html else regexp_replace(left(html, 104), '\s+$', '') || chr(10) || '# ... truncated ...' end as cut,
    case when length(html) <= 50 then html else regexp_replace(left(html, 47), '\s+$', '') || '...' end as short, array_to_string(string_split(html, chr(10))[2:4], chr(10)) as lines from pages"""
)
def truncate_sig(t):
    return t("pages").select("page_id", text.truncated("html", 120).alias("cut"), text.ellipsis("html", 50).alias("short"), text.line_slice("html", F.lit(2), F.lit(4)).alias("lines"))


@query(
    """with f as (select conv_id, role, min(turn) as first from conversations group by 1, 2), r as (select *, row_number() over (partition by conv_id order by first) as n from f)
    select conv_id, string_agg(role, ',' order by n) as roles from r where n <= 8 group by 1"""
)
def ordered_dedupe(t):
    return usage.first_seen(t("conversations"), ["conv_id"], "role", "turn", 8).select("conv_id", F.array_join("values", ",").alias("roles"))


@query("select page_id, sha256(html) as sha256, length(html)::bigint as size from pages")
def fingerprints(t):
    return t("pages").select("page_id", code.fingerprint(F.col("html")).alias("sha256"), F.length("html").cast("long").alias("size"))


@query("""select doc_id, running::bigint as running from (select doc_id, sum(n_chars) over (order by doc_id) as running from documents) where running <= 500000""")
def prompt_budget(t):
    return graph.running_budget(t("documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], 500000).select("doc_id", "running")


@query(
    r"""select doc_id, left(regexp_replace(lower(source || '/' || lang), '[^a-z0-9]+', '_', 'g'), 40) as slug, 'kb_' || left(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), 40) || '_' || left(sha1(source), 8) as collection,
    sha256(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^ | $', '', 'g')) as whole_sha256 from documents"""
)
def names_and_slugs(t):
    return t("documents").select("doc_id", text.slug(F.concat_ws("/", "source", "lang")).alias("slug"), text.collection_name("kb", "source").alias("collection"), F.sha2(text.collapsed("text"), 256).alias("whole_sha256"))


@query(
    r"""select doc_id, sha256(c) as sha256, length(c)::bigint as size
    from (select doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^ | $', '', 'g') as c from documents)"""
)
def collapsed_texts(t):
    """The white space of whole texts, however long; their digests and lengths."""
    whole = t("documents").select("doc_id", text.collapsed("text").alias("c"))
    return whole.select("doc_id", F.sha2("c", 256).alias("sha256"), F.length("c").cast("long").alias("size"))


@query(
    """with a as (select distinct doc_id from documents where doc_id % 4 <> 0), b as (select distinct vec_id as doc_id from embeddings)
    select count(a.doc_id) as documents, count(b.doc_id) as vectors, count(*) filter (b.doc_id is null) as missing_vectors, count(*) filter (a.doc_id is null) as orphan_vectors from a full join b using (doc_id)"""
)
def reconcile_counts(t):
    return diff.reconciled(t("documents").where("doc_id % 4 <> 0"), t("embeddings").select(F.col("vec_id").alias("doc_id")))


@query(
    """with s as (select p_brand || '.' || replace(p_type, ' ', '.') || '.' || p_partkey as q from part), x as (select q, string_split(q, '.') as p from s),
    y as (select q, array_to_string(p[len(p) - n + 1:], '.') as alias from x, (select unnest(range(1, 5)) as n) where n <= len(p))
    select alias, min(q) as qualname from y group by 1 having count(distinct q) = 1"""
)
def alias_table(t):
    names = t("part").select(F.concat_ws(".", "p_brand", F.translate("p_type", " ", "."), F.col("p_partkey").cast("string")).alias("qualname"))
    return graph.aliases(names)


@query("""select true as ok, doc_id, '{"doc":' || doc_id || '}' as json from documents""")
def json_recovery(t):
    """Damaged replies of one object each, repaired."""
    raw = F.expr("""concat('Sure:\n```json\n{"doc": ', doc_id, ',}\n```')""")
    rows = t("documents").select("doc_id", raw.alias("raw"))
    return sources.replies(rows).select((~F.col("needs_review")).alias("ok"), "doc_id", "json")


from . import operator_queries, rule_queries  # noqa: E402, F401  register their queries
