"""Queries of retrieval: dense, keyword and fused scores, quotas, pooling, routing, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import scalars
from plenum.operators import search as S
from plenum.operators import updates as U
from plenum.operators.lexical import LexicalIndex
from plenum.operators.relational import first_per
from plenum.shared import kept, written

from .registry import query

#: DuckDB: the cosine of two lists of floats, in double precision.
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
COS = "(" + DOT.replace("{a}", "v").replace("{b}", "q") + " / (sqrt(" + DOT.replace("{a}", "v").replace("{b}", "v") + ") * sqrt(" + DOT.replace("{a}", "q").replace("{b}", "q") + ")))"
PAIRS = f"""pairs as (select query_id, id, lang, {COS} as dense from
 (select item_id as query_id, embedding as q from benchmark join embeddings on vec_id = item_id), (select d.doc_id as id, d.lang, e.embedding as v from documents d join embeddings e on e.vec_id = d.doc_id))"""
BM25 = """toks as (select doc_id as id, lang, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as t from documents),
size as (select lang, count(*) as n_docs, avg(len(t)) as avg_len from toks group by lang),
asked as (select query_id, token, count(*) as times from (select item_id as query_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as token from benchmark) group by all),
tf as (select id, lang, len, token, count(*) as tf from (select id, lang, len(t) as len, unnest(t) as token from toks) where token in (select token from asked) group by all),
df as (select lang, token, count(*) as df from tf group by all),
bm as (select query_id, lang, id, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as keyword
 from tf join df using (lang, token) join size using (lang) join asked using (token) group by all)"""


def _queries(t):
    return t("questions").join(t("vectors").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q")), "question_id").select(F.col("question_id").alias("query_id"), "q", "text")


def _vectors(t):
    return t("chunks").join(t("vectors").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), "chunk_id").select(F.col("chunk_id").alias("id"), F.col("collection").alias("lang"), "v")


def _index(t):
    """The keyword index of the documents; built by the first query that needs it, then read by the others as long as the table's files stay the same."""
    docs = t("chunks").select(F.col("chunk_id").alias("id"), F.col("collection").alias("scope"), "text")
    return LexicalIndex(t.spark, kept("keyword-index", docs, lambda path: LexicalIndex(t.spark, path).insert(docs)))


def _texts(t):
    return t("questions").select(F.col("question_id").alias("query_id"), "text")


#: A collection of a workspace is searched by itself; rows that name neither lie in none. IDF as the reference's library has it: those below 0 become a quarter of the mean over the scope's tokens.
SCOPED = f"""pairs as (select query_id, id, lang, workspace, {COS} as dense from
 (select item_id as query_id, embedding as q from benchmark join embeddings on vec_id = item_id), (select d.doc_id as id, d.lang, d.source as workspace, e.embedding as v from documents d join embeddings e on e.vec_id = d.doc_id where d.lang is not null and d.source is not null)),
toks as (select doc_id as id, lang, source as workspace, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as t from documents where lang is not null and source is not null),
size as (select lang, workspace, count(*) as n_docs, avg(len(t)) as avg_len from toks group by all),
asked as (select query_id, token, count(*) as times from (select item_id as query_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as token from benchmark) group by all),
tf as (select id, lang, workspace, len, token, count(*) as tf from (select id, lang, workspace, len(t) as len, unnest(t) as token from toks) group by all),
raw as (select lang, workspace, token, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf join size using (lang, workspace) group by lang, workspace, token),
mean as (select lang, workspace, avg(raw) as mean from raw group by all),
idf as (select lang, workspace, token, case when raw < 0 then 0.25 * mean else raw end as idf from raw join mean using (lang, workspace) where token in (select token from asked)),
bm as (select query_id, lang, workspace, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as keyword
 from tf join idf using (lang, workspace, token) join size using (lang, workspace) join asked using (token) group by all)"""


def _workspaces(t):
    return t("chunks").where("collection is not null and workspace is not null").withColumn("scope", F.to_json(F.array("collection", "workspace")))


def _workspace_index(t):
    """The keyword index of each workspace's collections; kept as that of ``_index``."""
    docs = _workspaces(t).select(F.col("chunk_id").alias("id"), "scope", "text")
    return LexicalIndex(t.spark, kept("workspace-index", docs, lambda path: LexicalIndex(t.spark, path).insert(docs)))


@query(
    "search_hybrid",
    f"""with {SCOPED}, near as (select * from (select *, row_number() over (partition by query_id, lang, workspace order by dense desc, id) as r from pairs) where r <= 5),
most as (select query_id, lang, workspace, max(keyword) as most from bm group by all),
fused as (select query_id, lang, workspace, id, round(0.7 * dense + 0.3 * least(greatest(coalesce(keyword, 0) / case when most > 0 then most else 1 end, 0), 1), 4) as score
 from near left join bm using (query_id, lang, workspace, id) left join most using (query_id, lang, workspace))
select query_id, workspace, lang, row_number() over (partition by query_id, workspace, lang order by score desc, id)::int as rank, id, score, row_number() over (partition by query_id, workspace order by score desc, id)::int as place from fused""",
)
def _(t):
    # A document without a vector can't be a candidate, but its words count.
    vectors = _workspaces(t).join(t("vectors").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), "chunk_id").select(F.col("chunk_id").alias("id"), "scope", "v")
    near = written(S.nearest(_queries(t).select("query_id", "q"), vectors, 5, "scope"), "near")
    words, most = _workspace_index(t).among(_texts(t), near, floor=0.25)
    found = S.fused(near, words, "scope", 5, most=most).withColumn("scope", F.from_json("scope", "array<string>"))
    found = found.select("query_id", F.col("scope")[1].alias("workspace"), F.col("scope")[0].alias("lang"), "rank", "id", "score")
    return S.merged(found, ["query_id", "workspace"])


@query("s1_dense_top", f"with {PAIRS} select query_id, id, round(dense, 9) as dense, rank::int as rank from (select *, row_number() over (partition by query_id order by dense desc, id) as rank from pairs) where rank <= 10")
def _(t):
    near = S.nearest(_queries(t).select("query_id", "q"), _vectors(t).drop("lang"), 10)
    return S.top(near, ["query_id"], "dense", "id", 10).select("query_id", "id", F.round("dense", 9).alias("dense"), "rank")


@query("s2_bm25", f"with {BM25} select query_id, lang, id, round(keyword, 9) as keyword from (select *, row_number() over (partition by query_id, lang order by round(keyword, 9) desc, id) as r from bm) where r <= 10")
def _(t):
    return _index(t).top(_texts(t), 10, digits=9).select("query_id", F.col("scope").alias("lang"), "id", "keyword")


@query("s3_normalised", f"with {BM25} select query_id, lang, count(*) as n, round(sum(keyword / most), 6) as total from (select *, max(keyword) over (partition by query_id, lang) as most from bm) group by all")
def _(t):
    return _index(t).totals(_texts(t)).select("query_id", F.col("scope").alias("lang"), "n", F.round(F.col("total") / F.col("most"), 6).alias("total"))


SCORED = "select event_id as id, user_id as key, event_type as source, value / 500 as score from events"


def _scored(t):
    return t("activity").select(F.col("event_id").alias("id"), F.col("session_id").alias("key"), F.col("kind").alias("source"), (F.col("value") / 500).alias("score"))


@query("w4_top_per_source", f"select id, key, source, rank::int as rank from (select *, row_number() over (partition by source order by score desc, id) as rank from ({SCORED})) where rank <= 10")
def _(t):
    return S.top(_scored(t), ["source"], "score", "id", 10).select("id", "key", "source", "rank")


@query(
    "w5_quota_merge",
    f"""with r as (select *, row_number() over (partition by key, source order by score desc, id) as r from ({SCORED})),
p as (select *, row_number() over (partition by key order by r > 2, case when r <= 2 then r end nulls first, case when r <= 2 then source end nulls first, score desc, id) as p from r)
select key, id, source, row_number() over (partition by key order by score desc, id)::int as rank from p where p <= 6""",
)
def _(t):
    return S.quota_merge(_scored(t), ["key"], "source", "score", "id").select("key", "id", "source", "rank")


@query(
    "w6_guaranteed",
    f"""with o as (select * from (select *, row_number() over (partition by key, source order by score desc, id) as r from ({SCORED})) where r <= 2)
select key, id, source, rank::int as rank from (select *, row_number() over (partition by key order by score desc, id) as rank from o) where rank <= 10""",
)
def _(t):
    return S.guaranteed(_scored(t), ["key"], "source", "score", "id", 10, 5).select("key", "id", "source", "rank")


@query("s6_rerank_fallback", f"select id, coalesce(case when id % 3 = 0 then score / 2 end, score) as final from ({SCORED})")
def _(t):
    return _scored(t).withColumn("rerank", F.when(F.col("id") % 3 == 0, F.col("score") / 2)).select("id", U.attached_score(F.col("score"), F.col("rerank")).alias("final"))


@query("s7_collection_bonus", f"select id, round(score + case when source = 'view' then key * 0.0005 else 0 end, 9) as final from ({SCORED})")
def _(t):
    return _scored(t).select("id", F.round(U.with_bonus(F.col("score"), F.col("key") * 0.0005, F.col("source") == "view"), 9).alias("final"))


@query("s8_low_confidence", f"select key, max(score) < 0.4 as low from ({SCORED}) group by key")
def _(t):
    return _scored(t).groupBy("key").agg(U.low_confidence("score").alias("low"))


@query(
    "s9_routing",
    """select question_id, unnest(case when len(r) > 0 then r else ['document', 'meeting'] end) as collection from (
 select question_id, list_filter([case when contains(lower(text), 'thou') or contains(lower(text), 'inon') then 'document' end, case when contains(lower(text), 'blest') then 'meeting' end], lambda x: x is not null) as r from {questions})""",
)
def _(t):
    r = scalars.routes(F.col("text"), {"document": ["thou", "inon"], "meeting": ["blest"]})
    return t("questions").select("question_id", F.explode(r).alias("collection"))


@query("s11_clamp", "select event_id, least(greatest(coalesce(try_cast(case when event_id % 5 = 0 then 'n/a' else cast(value / 100 - 0.2 as string) end as double), 0), 0), 1) as score from {activity}")
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("value") / 100 - 0.2).cast("string"))
    return t("activity").select("event_id", scalars.clamp_score(raw).alias("score"))


@query(
    "s13_sources",
    """select d.decision_id, coalesce(f.filename, m.title) as title, case when f.filename is not null then 'file' else 'meeting' end as kind from {decisions} d
left join (select * from {files} where rag_enabled and is_latest and status = 'completed' and not deleted) f on f.file_id = d.topic_id left join {meetings} m using (meeting_id) where d.status = 'active'""",
)
def _(t):
    f = t("files").where("rag_enabled and is_latest and status = 'completed' and not deleted").select(F.col("file_id").alias("topic_id"), "filename")
    d = t("decisions").where("status = 'active'").join(f, "topic_id", "left").join(t("meetings").select("meeting_id", "title"), "meeting_id", "left")
    return d.select("decision_id", F.coalesce("filename", "title").alias("title"), F.when(F.col("filename").isNotNull(), "file").otherwise("meeting").alias("kind"))


@query("s14_candidates", f"select key, id, n::int as n from (select *, row_number() over (partition by key order by score desc, id) as n from ({SCORED})) where n <= 15 and score >= 0.4 and n <= 5")
def _(t):
    return S.top(_scored(t), ["key"], "score", "id", 15).where("score >= 0.4 and rank <= 5").select("key", "id", F.col("rank").alias("n"))


@query(
    "s15_recommend_once",
    f"select key, id, source from (select *, row_number() over (partition by key order by score desc, id) as n from ({SCORED})) where n = 1 and score >= 0.3 and key not in (select session_id from {{judgements}} where decision_id = 7)",
)
def _(t):
    best = S.top(_scored(t), ["key"], "score", "id", 1).where("score >= 0.3")
    seen = t("judgements").where("decision_id = 7").select(F.col("session_id").alias("key"))
    return best.join(seen, "key", "left_anti").select("key", "id", "source")


@query("s16_graph", "select a.decision_id, f.filename, a.score from {decisions} a join {files} f on a.topic_id = f.file_id where a.score >= 0.9 and f.is_latest")
def _(t):
    f = t("files").where("is_latest").select(F.col("file_id").alias("topic_id"), "filename")
    return t("decisions").where("score >= 0.9").join(f, "topic_id").select("decision_id", "filename", "score")


@query(
    "s17_history",
    """select meeting_id, string_agg(speaker || ': ' || coalesce(text, ''), chr(10) order by segment_index) as context from (select *, row_number() over (partition by meeting_id order by segment_index desc) as r from {segments}) where r <= 4 group by meeting_id""",
)
def _(t):
    last = first_per(t("segments"), ["meeting_id"], F.desc("segment_index"), k=4)
    g = last.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", F.concat("speaker", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")))).alias("x"))
    return g.select("meeting_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("context"))


MEANS = "select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by all"


@query("a9_mean_pool", f"select label, i - 1 as at, round(x, 9) as x from ({MEANS})")
def _(t):
    return S.mean_pool(t("vectors"), "label", "embedding").select("label", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.round("x", 9))


GROUPS = "select label * 20 + vec_id % 20 as doc, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by all"


@query(
    "a10_similar_files",
    f"""with m as (select doc, list(x order by i) as v from ({GROUPS}) group by doc), n as (select a.doc as a, b.doc as b, {DOT.replace('{a}', 'a.v').replace('{b}', 'b.v')} / (sqrt({DOT.replace('{a}', 'a.v').replace('{b}', 'a.v')}) * sqrt({DOT.replace('{a}', 'b.v').replace('{b}', 'b.v')})) as score from m a join m b on a.doc < b.doc),
o as (select a.doc as a, b.doc as b, -1.0 as score from m a join m b on b.doc = a.doc + 1)
select a, b, round(score, 6) as score from n where score >= 0.2 union all select a, b, score from o where not exists (select 1 from n where n.a = o.a and n.b = o.b and n.score >= 0.2)""",
)
def _(t):
    from plenum.operators.relational import replace_pairs

    docs = t("vectors").select((F.col("label") * 20 + F.col("vec_id") % 20).alias("id"), "embedding")
    pooled = S.mean_pool(docs, "id", "embedding").select("id", F.col("embedding").alias("v"))
    # Random vectors reach no 0.6; the pairs of neighbouring numbers were there before.
    new = S.similar_pairs(pooled, 0.2).withColumn("score", F.round("score", 6))
    ids = pooled.select("id")
    old = ids.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", F.lit(-1.0).alias("score"))
    return replace_pairs(old, new, "a", "b").select("a", "b", "score")


@query(
    "p1_closed_set",
    f"""with m as ({MEANS}), p as (select label, list(x order by i) as q from m group by label), s as (select vec_id, p.label as name, {COS} as score from (select vec_id, embedding as v from embeddings), p),
r as (select *, row_number() over (partition by vec_id order by score desc, name) as n, lead(score) over (partition by vec_id order by score desc, name) as next from s)
select vec_id, case when score >= 0.35 and score - next >= 0.05 then name end as name from r where n = 1""",
)
def _(t):
    from plenum.operators.speakers import closed_set

    profiles = S.mean_pool(t("vectors"), "label", "embedding").select(F.col("label").alias("name"), F.col("embedding").alias("q"))
    return closed_set(t("vectors").select("vec_id", F.col("embedding").alias("v")), profiles, "vec_id").select("vec_id", "name")


@query("p2_open_set")
def _(t):
    from plenum.operators.speakers import open_set

    return open_set(t("vectors").select(F.col("label").alias("session"), F.col("vec_id").alias("seq"), F.col("embedding").alias("v")), "session", "seq")


@query("p3_unassigned")
def _(t):
    from plenum.operators.speakers import unassigned

    return unassigned(t("vectors").select(F.col("label").alias("session"), F.col("vec_id").alias("seq"), F.col("embedding").alias("v")), "session", "seq")


@query("p4_agglomerate")
def _(t):
    from plenum.operators.speakers import agglomerate

    pooled = S.mean_pool(t("vectors").select((F.col("label") * 12 + F.col("vec_id") % 12).alias("id"), "embedding"), "id", "embedding")
    return agglomerate(pooled.select(F.floor(F.col("id") / 12).alias("session"), (F.col("id") % 12).alias("item"), F.col("embedding").alias("v")), "session", "item")


@query("io16_first_present", "select event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.none'), kind) as k from {activity}")
def _(t):
    from plenum.sources.readers import first_present

    return t("activity").select("event_id", F.coalesce(first_present("props", "$.tags", "$.k", "$.none"), "kind").alias("k"))
