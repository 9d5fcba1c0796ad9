"""Search queries with their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.operators import search as s
from evidlake.operators.text_index import TextIndex
from evidlake.plans import domain as d
from evidlake.session import new_path, passing, spread, table

LIMIT = 10
#: The fixed text queries: single words, several, a phrase by hyphen, one without any hit.
TEXT = [(1, "pulsar telescope"), (2, "invoice"), (3, "storage-heater boiler"), (4, "missing turns into"), (5, "zzzz nothing"), (6, "lock-free")]


def _text_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXT, "qid bigint, query string")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return s.live(d.doc_entries(spark, sf))


def _out(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


def semantic(spark, sf):
    return _out(s.ranked(s.similarities(d.live_vectors(spark, sf), d.vector_queries(spark, sf), LIMIT), ["qid"], "score", LIMIT))


def semantic_filtered(spark, sf):
    e = d.doc_entries(spark, sf).filter("not is_stale").filter(s.path_prefix(F.col("path"), "HERON-")).filter(F.array_contains("tags", "note"))
    v = d.doc_vectors(spark, sf).join(e.select("id"), "id", "left_semi")
    return _out(s.ranked(s.similarities(v, d.vector_queries(spark, sf), LIMIT), ["qid"], "score", LIMIT))


def text_scores(spark, sf):
    return s.full_text(spread(_docs(spark, sf)), _text_queries(spark))


def fts(spark, sf):
    return _out(s.ranked(text_scores(spark, sf).withColumn("score", F.round("score", 9)), ["qid"], "score", LIMIT))


def fts_only(spark, sf):
    """What a search without vectors gives: score 1, the BM25 order as rank."""
    r = s.ranked(text_scores(spark, sf).withColumn("score", F.round("score", 9)), ["qid"], "score", LIMIT)
    return r.select("qid", "id", F.lit(1.0).alias("score"), F.lit("fts").alias("source"), "rank")


def fts_ties(spark, sf):
    return _out(s.tie_run(text_scores(spark, sf), 5))


def _lanes(spark, sf):
    """The text, semantic and cue lane. The vectors are scored twice: for the first of each lane, and to count what is
    before the candidates of all lanes."""
    q = s.small(d.doc_queries(spark, sf), "queries")
    vectors, docs, v = d.live_vectors(spark, sf), _docs(spark, sf), q.select("qid", "embedding")

    def words():
        text = s.full_text(spread(docs), q.select("qid", "query")).withColumn("score", F.round("score", 9))
        return s.small(s.ranked(text, ["qid"], "score", LIMIT), "text")

    # The lanes don't wait for each other.
    with ThreadPoolExecutor(3) as pool:
        text, cue, top = [f.result() for f in [
            pool.submit(words), pool.submit(_cues, spark, sf, docs, v),
            pool.submit(lambda: s.small(s.ranked(s.similarities(vectors, v, 2 * LIMIT, 9), ["qid"], "score", 2 * LIMIT).select("qid", "id"), "top")),
        ]]
    ids = text.select("qid", "id").unionByName(cue.select("qid", "id")).unionByName(top).distinct()
    return text, s.ranks_of(ids, vectors, v, 9), cue


def _cues(spark, sf, docs, v):
    """The best cue of each of the first live entries."""
    c = d.cues(spark, sf).select(F.col("entry").alias("id"), "cue", "embedding").join(docs.select("id"), "id", "left_semi")
    first = s.similarities(c, v, 2 * LIMIT, 9, "cue")
    best = first.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min_by("cue", F.struct(-F.col("score"), "cue")).alias("cue"))
    return s.small(s.ranked(best, ["qid"], "score", 2 * LIMIT), "cues")


def cue_lane(spark, sf):
    return _out(_cues(spark, sf, _docs(spark, sf), d.doc_queries(spark, sf).select("qid", "embedding")).select("qid", "id", "cue", "score", "rank"))


def fused(spark, sf):
    return s.fuse(*_lanes(spark, sf), LIMIT).withColumn("score", F.round("score", 12))


def hybrid(spark, sf):
    return _out(s.ranked(fused(spark, sf), ["qid"], "score", LIMIT), 9)


def recent(spark, sf, rate=0.01):
    f = fused(spark, sf).join(d.doc_entries(spark, sf).select("id", "updated_at"), "id")
    f = s.decayed(f, "updated_at", d.AS_OF, rate).drop("updated_at").withColumn("score", F.round("score", 12))
    return _out(s.ranked(f, ["qid"], "score", LIMIT), 9)


def mmr(spark, sf):
    return _out(s.diversified(fused(spark, sf), d.doc_vectors(spark, sf), 0.5, LIMIT), 9)


def federated(spark, sf):
    """Each source is a repository, heron-atlas the local one; documents of other languages exist twice."""
    e = _docs(spark, sf).select("id", F.col("source").alias("origin"), F.col("doc_id"))
    sc = text_scores(spark, sf).withColumn("score", F.round("score", 9)).join(e, "id")
    rows = sc.withColumn("id", F.concat(F.lit("r"), (F.col("doc_id") % 40).cast("string"))).withColumn("is_local", F.col("origin") == "heron-atlas")
    return s.federated(rows.drop("doc_id").filter("origin is not null"), LIMIT)


def near_probe(spark, sf):
    """The five most similar other entries of each query vector with a cosine of 0.2 or more."""
    r = s.ranked(s.similarities(d.live_vectors(spark, sf), d.vector_queries(spark, sf), 6).filter(F.col("id") != F.lpad(F.col("qid").cast("string"), 10, "0")), ["qid"], "score", 5)
    return _out(r.filter("score >= 0.2"))


def missing_embeddings(spark, sf):
    e = s.live(d.doc_entries(spark, sf)).join(d.doc_vectors(spark, sf).select("id"), "id", "left_anti")
    fits = F.octet_length("text") <= 1800
    return e.select("id", F.when(fits, "embed").otherwise("skip").alias("verdict"))


def embedding_health(spark, sf):
    n = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0).cast("double"), lambda a, b: a + b))
    t = table(spark, sf, "embeddings").select("label", F.size("embedding").alias("dim"), n.alias("norm"))
    bad = F.col("norm").isNull() | F.isnan("norm") | (F.col("norm") == 0) | (F.col("dim") != 64)
    return t.groupBy("label").agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid"), F.count_if(F.abs(F.col("norm") - 1) < 1e-3).alias("normalized"))


def embed_text(spark, sf):
    """Text to embed in both modes, as its hash."""
    e = s.live(d.entries(spark, sf))
    full = F.concat_ws(" ", "path", "summary", "content")
    short = F.concat_ws(" ", "path", "summary", F.array_join("tags", " "))
    return e.select("id", F.md5(full.cast("binary")).alias("full_md5"), short.alias("abstraction"))


def expand(spark, sf):
    """The first 32 live entries are the seeds, as many as the operator takes."""
    e = d.entries(spark, sf)
    return s.expanded(e, e.select("id"), d.evidence(spark, sf))


def fts_columns(spark, sf):
    """Path, text and tags as columns of the index; a phrase lies within one of them."""
    e = _docs(spark, sf).withColumn("tag_text", F.array_join("tags", " "))
    q = spark.createDataFrame([(1, "heron atlas"), (2, "note invoice"), (3, "lock-free"), (4, "zzzz")], "qid bigint, query string")
    return _out(s.ranked(s.full_text(spread(e), q, ("path", "text", "tag_text")).withColumn("score", F.round("score", 9)), ["qid"], "score", LIMIT))


def fts_index(spark, sf):
    """The same as fts_topk from a kept index: all documents, stale ones too, then these are taken out."""
    x = TextIndex(spark, path := new_path(spark, "index"), ["text"])
    e = d.doc_entries(spark, sf)
    x.upsert(spread(e.select("id", "text")))
    x.remove(e.filter("is_stale").select("id"))
    passing(spark, path)
    return _out(s.ranked(x.search(_text_queries(spark)).withColumn("score", F.round("score", 9)), ["qid"], "score", LIMIT))


#: The working set of the context queries.
FILES = ["src/align/replay_rank.md", "src/flush/lease_span.rs", "ops/shard/bind_window.py", "lib/quota/bind_probe.ex"]


def context_candidates(spark, sf):
    e = d.entries(spark, sf)
    hits = s.ranked(s.full_text(s.live(e).select("id", F.concat_ws(" ", "path", "summary", "content").alias("text")), spark.createDataFrame([(1, "missing turns")], "qid bigint, query string")).withColumn("score", F.round("score", 9)), ["qid"], "score", 100)
    # All text scores of this lane are 1, so hits are ranked by id.
    files = [r.f for r in d.evidence(spark, sf).filter("citation_path is not null").groupBy(F.regexp_replace("citation_path", r":\d+-\d+$", "").alias("f")).count().orderBy(F.desc("count"), "f").limit(20).collect()]
    return s.context_candidates(e, d.evidence(spark, sf), files, s.ranked(hits.select("qid", "id", F.lit(1.0).alias("score")), ["qid"], "score", 100))


def context_ranked(spark, sf):
    c = context_candidates(spark, sf)
    return c.select("id", "n_tokens", F.round("overlap", 9).alias("overlap"), F.round("fts", 9).alias("fts"), F.round("score", 9).alias("score"))


def context_packed(spark, sf):
    return s.context_pack(context_ranked(spark, sf), 4000)


QUERIES = {
    "semantic_topk": semantic, "semantic_topk_filtered": semantic_filtered, "fts_topk": fts, "fts_only_result": fts_only, "fts_tie_run": fts_ties,
    "cue_lane": cue_lane, "hybrid_rrf": hybrid, "hybrid_recency": recent, "hybrid_mmr": mmr, "federated_search": federated,
    "near_duplicate_probe": near_probe, "missing_embeddings": missing_embeddings, "embedding_health": embedding_health, "embed_text": embed_text,
    "frontier_expand": expand, "fts_columns_topk": fts_columns, "fts_index_topk": fts_index, "context_candidates": context_ranked, "context_pack": context_packed,
}

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25(docs: str, queries: str) -> str:
    """CTEs up to ``bm`` (qid, id, score); docs and queries are names of CTEs (id, text) and (qid, query)."""
    return rf"""
tk as materialized (select id, {_TOK.format("coalesce(text, '')")} as t from {docs}),
stat as (select count(*) as n_docs, avg(len(t)) as avg_len from tk),
qt as (select qid, generate_subscripts(w, 1) as term, unnest(w) as w from (select qid, regexp_split_to_array(trim(query), '\s+') as w from {queries})),
qp as (select qid, term, len(t) as n, generate_subscripts(t, 1) as j, unnest(t) as token from (select qid, term, {_TOK.format('w')} as t from qt) where len(t) > 0),
oc as (select id, len(t) as len, generate_subscripts(t, 1) as pos, unnest(t) as token from tk),
h1 as (select qid, term, n, id, oc.len, pos - j as start, count(distinct j) as m from oc join qp using (token) group by all),
h2 as (select qid, term, id, len, count(*) as tf from h1 where m = n group by all),
dfs as (select qid, term, count(*) as df from h2 group by all),
bm as (select h2.qid, h2.id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) as score
  from h2 join dfs using (qid, term) cross join stat group by h2.qid, h2.id
  having count(*) = (select count(distinct term) from qp where qp.qid = h2.qid))"""


_QUERIES = "tq as (select * from (values " + ", ".join(f"({i}::bigint, '{t}')" for i, t in TEXT) + ") x(qid, query))"
_LIVE = "ld as (select * from d where not is_stale)"
_BM = f"{d.SQL_DOC}, {_LIVE}, {_QUERIES}, {_bm25('ld', 'tq')}"
_RANK = "row_number() over (partition by qid order by score desc, id)"
_VEC = "lpad(vec_id::varchar, 10, '0')"
_COS = "list_cosine_similarity(q.embedding::double[], v.embedding::double[])"


def _semantic(where: str, k: str = "10") -> str:
    return f"""with {d.SQL_DOC}, x as (select q.vec_id as qid, d.id, {_COS} as score from embeddings q cross join embeddings v join d on d.doc_id = v.vec_id
    where q.vec_id % 100 = 0 and not is_stale and {where})"""


_LANES = rf"""{d.SQL_DOC}, {_LIVE},
dq as (select doc_id as qid, t[3] || ' ' || t[4] as query, embedding from (select doc_id, {_TOK.format('text')} as t from d where doc_id % 100 = 0) join embeddings on vec_id = doc_id where len(t) >= 4),
{_bm25('ld', 'dq')},
l0 as (select * from (select *, {_RANK} as rank from bm) where rank <= 10),
sx as (select qid, lpad(v.vec_id::varchar, 10, '0') as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as score from dq q cross join embeddings v where v.vec_id in (select doc_id from ld)),
l1 as (select *, {_RANK} as rank from sx),
cx as (select qid, lpad((v.vec_id * 7 % (select count(*) from embeddings))::varchar, 10, '0') as id, 'cue ' || label as cue, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as score from dq q cross join embeddings v),
cb as (select qid, id, cue, score from (select *, row_number() over (partition by qid, id order by score desc, cue) as k from cx where id in (select id from ld)) where k = 1),
l2 as (select * from (select *, {_RANK} as rank from cb) where rank <= 20),
lanes as (select qid, id, rank, 0 as lane from l0 union all select qid, id, rank, 1 from l1 union all select qid, id, rank, 2 from l2),
fu as (select qid, id, round(sum(1.0::double / (60 + rank)), 12) as score, min(case when lane <> 1 or rank <= 20 then lane end) as first from lanes group by all),
fs as (select qid, id, score, case first when 0 then 'fts' when 1 then 'semantic' else 'cue' end as source from fu where first is not null)"""
_TOP = "select * exclude (rank), rank from (select *, " + _RANK + " as rank from {}) where rank <= 10"
_CTX = rf"""{d.SQL_ENTRY}, {d.SQL_EVIDENCE}, le as (select id, concat_ws(' ', path, summary, content) as text, octet_length(encode(summary)) + octet_length(encode(content)) as bytes from e where not is_stale),
cq as (select 1::bigint as qid, 'missing turns' as query), {_bm25('le', 'cq')},
hits as (select id, row_number() over (order by id) as rank from (select *, {_RANK} as k from bm) where k <= 100),
fl as (select regexp_replace(citation_path, ':\d+-\d+$', '') as f, count(*) as n from v where citation_path is not null group by all order by n desc, f limit 20),
ov as (select entry_id as id, avg((regexp_replace(citation_path, ':\d+-\d+$', '') in (select f from fl))::int::double) as overlap from v where citation_path is not null group by all),
cc as (select le.id, ceil(bytes / 4)::bigint as n_tokens, coalesce(overlap, 0) as overlap, coalesce(1.0::double / (60 + rank), 0) as fts from le left join ov using (id) left join hits using (id))
"""
#: Joined columns do here, as no phrase of these queries can begin in one and end in the next.
_COLS = rf"""{d.SQL_DOC}, {_LIVE}, tq as (select * from (values (1::bigint, 'heron atlas'), (2::bigint, 'note invoice'), (3::bigint, 'lock-free'), (4::bigint, 'zzzz')) x(qid, query)),
  lc as (select id, concat_ws(' ', path, text, source, doc_type) as text from ld), {_bm25('lc', 'tq')}"""


def _mmr() -> str:
    """The greedy choice, one step after the other: each takes the row that is worth the most beside those taken before."""
    out = f"""{_LANES}, po as (select qid, id, score, max(score) over (partition by qid) as top, rank, embedding::double[] as v from (select *, {_RANK} as rank from fs) left join embeddings on lpad(vec_id::varchar, 10, '0') = id where rank <= 20),
si as (select a.qid, a.id as a, b.id as b, coalesce(list_cosine_similarity(a.v, b.v), 0) as sim from po a join po b on a.qid = b.qid),
c1 as (select qid, id, score, 1 as rank from po where rank = 1)"""
    for k in range(2, LIMIT + 1):
        out += f""",
n{k} as (select po.qid, po.id, po.score, 0.5 * po.score / top - 0.5 * greatest(0, max(sim)) as worth from po join c{k - 1} c on c.qid = po.qid join si on si.qid = po.qid and si.a = po.id and si.b = c.id
  where not exists (select 1 from c{k - 1} x where x.qid = po.qid and x.id = po.id) group by po.qid, po.id, po.score, top),
c{k} as materialized (select * from c{k - 1} union all select qid, id, score, {k} from (select *, row_number() over (partition by qid order by worth desc, score desc, id) as r from n{k}) where r = 1)"""
    return f"with {out} select qid, id, round(score, 9) as score, rank::bigint as rank from c{LIMIT}"


SQL = {
    "hybrid_mmr": _mmr(),
    "fts_columns_topk": f"with {_COLS} select qid, id, round(score, 6) as score, rank from (select *, {_RANK} as rank from bm) where rank <= 10",
    "fts_index_topk": f"with {_BM} select qid, id, round(score, 6) as score, rank from (select *, {_RANK} as rank from bm) where rank <= 10",
    "semantic_topk": f"{_semantic('true')} select qid, id, round(score, 6) as score, rank from (select *, {_RANK} as rank from x) where rank <= 10",
    "semantic_topk_filtered": f"""{_semantic("lower(d.path) like 'heron-%' and doc_type = 'note'")} select qid, id, round(score, 6) as score, rank from (select *, {_RANK} as rank from x) where rank <= 10""",
    "fts_topk": f"with {_BM} select qid, id, round(score, 6) as score, rank from (select *, {_RANK} as rank from bm) where rank <= 10",
    "fts_only_result": f"with {_BM} select qid, id, 1.0::double as score, 'fts' as source, rank from (select *, {_RANK} as rank from bm) where rank <= 10",
    "fts_tie_run": f"with {_BM} select qid, id, round(score, 6) as score, rank from (select *, rank() over (partition by qid order by score desc) as rank from bm) where rank <= 5",
    "cue_lane": f"with {_LANES} select qid, id, cue, round(score, 6) as score, rank from l2",
    "hybrid_rrf": f"with {_LANES} select qid, id, round(score, 9) as score, source, rank from (select *, {_RANK} as rank from fs) where rank <= 10",
    "hybrid_recency": f"""with {_LANES}, fd as (select qid, fs.id, fs.source, round(score * exp(-0.01 * greatest(0, (epoch_us(timestamp '2026-01-01') - epoch_us(updated_at::timestamp)) / 86400000000.0)), 12) as score from fs join d using (id))
        select qid, id, round(score, 9) as score, source, rank from (select *, {_RANK} as rank from fd) where rank <= 10""",
    "federated_search": f"""with {_BM}, r as (select qid, 'r' || (doc_id % 40) as id, score, source as origin, source = 'heron-atlas' as is_local from bm join d using (id) where source is not null),
        b as (select * exclude (k) from (select *, row_number() over (partition by qid, id order by is_local desc, score desc, origin) as k from r) where k = 1)
        select * from (select *, row_number() over (partition by qid order by score desc, is_local desc, origin, id) as rank from b) where rank <= 10""",
    "near_duplicate_probe": f"""{_semantic('q.vec_id <> v.vec_id')} select qid, id, round(score, 6) as score, rank from (select *, {_RANK} as rank from x) where rank <= 5 and score >= 0.2""",
    "missing_embeddings": f"with {d.SQL_DOC} select id, case when octet_length(encode(text)) <= 1800 then 'embed' else 'skip' end as verdict from d where not is_stale and doc_id not in (select vec_id from embeddings)",
    "embedding_health": """select label, count(*) as n, count(*) filter (norm is null or isnan(norm) or norm = 0 or dim <> 64) as invalid, count(*) filter (abs(norm - 1) < 1e-3) as normalized
        from (select label, len(embedding) as dim, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings) group by label""",
    "embed_text": f"with {d.SQL_ENTRY} select id, md5(concat_ws(' ', path, summary, content)) as full_md5, concat_ws(' ', path, summary, array_to_string(tags, ' ')) as abstraction from e where not is_stale",
    "frontier_expand": rf"""with {d.SQL_ENTRY}, {d.SQL_EVIDENCE}, le as (select *, regexp_extract(path, '^(.*)/', 1) as dir from e where not is_stale),
        s as (select * from le order by id limit 32), c as (select distinct entry_id as id, regexp_replace(citation_path, ':[^:]*$', '') as file from v where citation_path is not null),
        p as (select id, 'dir' as f from le where dir in (select dir from s)
          union select id, 'tag' from le where list_has_any(tags, (select flatten(list(tags)) from s))
          union select id, 'cue' from le where list_has_any(cues, (select flatten(list(cues)) from s))
          union select id, 'file' from c where file in (select file from c where id in (select id from s)))
        select id, count(*) as facets from p where id not in (select id from s) and id in (select id from le) group by id""",
    "context_pack": f"""with recursive {_CTX}, o as (select id, n_tokens, round(overlap, 9) as overlap, round(fts, 9) as fts, round(overlap + fts, 9) as score, row_number() over (order by round(overlap + fts, 9) desc, id) as i from cc where overlap + fts > 0),
        f as (select 0::bigint as i, 4000::bigint as room, false as taken union all select o.i, case when n_tokens <= room then room - n_tokens else room end, n_tokens <= room from f join o on o.i = f.i + 1)
        select id, n_tokens, overlap, fts, score from o join f using (i) where taken""",
    "context_candidates": f"with {_CTX} select id, n_tokens, round(overlap, 9) as overlap, round(fts, 9) as fts, round(overlap + fts, 9) as score from cc where overlap + fts > 0",
}
