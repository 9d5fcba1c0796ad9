"""Text and graph queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidlake.functions import texts as t
from evidlake.operators import graph as g
from evidlake.plans import domain as d
from evidlake.session import table


def _md5(parts):
    return F.md5(F.array_join(parts, "\u0001").cast("binary"))


def _content(spark, sf):
    return d.entries(spark, sf).filter("content is not null").select("id", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content"))


def paragraphs(spark, sf):
    p = t.paragraphs(F.col("content"))
    return _content(spark, sf).select("id", F.size(p).alias("n"), _md5(p).alias("md5"))


def merged(spark, sf):
    return _content(spark, sf).select("id", F.size(t.merged(t.paragraphs(F.col("content")), 100)).alias("n"))


def sentences(spark, sf):
    s = t.sentences(F.col("content"))
    return _content(spark, sf).select("id", F.size(s).alias("n"), _md5(s).alias("md5"))


def chunks(spark, sf):
    return t.chunk_rows(_content(spark, sf), "id", "content")


#: One secret of each kind, appended to the contents by turns of the id's first character.
SECRET = [
    "x sk-" + "Ab1" * 8, "ghp_" + "a1B2" * 9, "glpat-" + "x_-9" * 6, "xoxb-12-ab", "xoxp-1-a-b", "AKIA" + "Q7" * 8, "eyJa.b-c.d_e",
    "-----BEGIN A KEY-----\nxx\n-----END A KEY-----", "\nTOKEN_A=" + "0f" * 20, "no secret sk-short",
]


def redact(spark, sf):
    k = F.instr(F.lit("0123456789abcdef"), F.substring("id", 1, 1)) % len(SECRET)
    text = F.concat("content", F.lit(" "), F.element_at(F.array(*[F.lit(s) for s in SECRET]), k + 1))
    return _content(spark, sf).select("id", F.md5(t.redacted(text).cast("binary")).alias("md5"), t.redacted(text).contains("REDACTED").alias("hit"))


def excerpts(spark, sf):
    v = d.evidence(spark, sf).filter("citation_excerpt is not null").select("id", F.concat("citation_excerpt", F.when(F.startswith("id", F.lit("a")), "<<END>>").when(F.startswith("id", F.lit("b")), "\u0007").when(F.startswith("id", F.lit("c")), "<<<").otherwise("")).alias("x"))
    return v.select("id", t.excerpt_problem(F.col("x")).alias("problem"), t.wrapped(F.col("x")).alias("wrapped"))


def validation(spark, sf):
    e = d.entries(spark, sf)
    tags = F.when(F.startswith("id", F.lit("a")), F.concat("tags", F.array(F.lit("")))).when(F.startswith("id", F.lit("b")), F.concat("tags", F.array(F.lit("é" * 26)))).otherwise(F.col("tags"))
    kinds = F.col("kind").isin("observation", "belief", "procedure", "convention")
    return e.select("id", F.coalesce(F.when(F.length("summary") > 60, "summary_too_long"), F.when(~kinds, "unknown_kind"), t.tags_problem(tags)).alias("problem"))


def sizes(spark, sf):
    e = d.entries(spark, sf).filter("content is not null")
    p = t.first_paragraph(F.col("content"))
    return e.select("id", t.token_estimate(F.col("content")).alias("n_tokens"), F.md5(p.cast("binary")).alias("first_md5"), t.byte_prefix(F.col("summary"), 32).alias("short"), F.md5(t.clamped(F.col("content"), 9500).cast("binary")).alias("clamped_md5"))


def branches(spark, sf):
    b = F.concat(F.lit("feat-"), F.substring("id", 1, 4), F.lit("-"), F.col("path"))
    return d.entries(spark, sf).select("id", F.array_join(t.branch_tokens(b), " ").alias("words"))


def digests(spark, sf):
    """Transcript documents as sessions."""
    x = table(spark, sf, "documents").filter("doc_type = 'transcript' and text is not null").select("doc_id", F.regexp_replace("text", r"\r\n?|\n(?=\w+: )", "\n\n").alias("x"))
    x = x.withColumn("x", F.concat("x", F.lit("\n---\nBash(ls)\n")))
    g_ = t.digest(F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.col("x"))
    return x.select("doc_id", F.size(t.turns(F.col("x"))).alias("n_turns"), g_["hash"].alias("hash"))


def compress(spark, sf):
    """Paragraphs of long contents without near copies; a paragraph's vector counts its letters."""
    import pandas as pd

    def run(batches):
        for df in batches:
            n = []
            for p in df["parts"]:
                p = list(p)[:512]
                n.append(len(t.deduplicated(p, [[x.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for x in p], 0.97)))
            yield pd.DataFrame({"id": df["id"], "n_parts": df["parts"].str.len(), "n_kept": n})

    c = _content(spark, sf).filter(F.octet_length("content") > 4000).select("id", t.merged(t.paragraphs(F.col("content")), 100).alias("parts"))
    return c.mapInPandas(run, "id string, n_parts int, n_kept int")


def provenance(spark, sf):
    v = d.evidence(spark, sf).filter("kind = 'derived' and derived_from is not null")
    edges = v.select(F.col("entry_id").alias("src"), F.when(F.startswith("id", F.lit("7")), F.concat(F.lit("gone-"), "derived_from")).otherwise(F.col("derived_from")).alias("dst"))
    known = d.entries(spark, sf).select(F.col("id").alias("node"))
    return g.provenance(edges.select(F.col("src").alias("start")), edges, known)


def provenance_nodes(spark, sf):
    v = d.evidence(spark, sf).filter("kind = 'derived' and derived_from is not null and entry_id is not null")
    edges = v.select(F.col("entry_id").alias("src"), F.when(F.startswith("id", F.lit("7")), F.concat(F.lit("gone-"), "derived_from")).otherwise(F.col("derived_from")).alias("dst"))
    return g.provenance_nodes(edges.select(F.col("src").alias("start")), edges, d.entries(spark, sf).select(F.col("id").alias("node")), 3)


def peers_swept(spark, sf):
    """What stays of peers and graphs when those with a time to live of n_nationkey modulo 3 years are swept, counted."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("slug"), F.when(F.col("n_nationkey") % 4 != 0, (F.col("n_nationkey") % 3 * 365).cast("int")).alias("ttl_days"))
    kept, graphs = g.swept(g.with_ttl(n, "2025-01-01 00:00:00Z"), n.select("slug"), "2026-01-01")
    return kept.select("src", "slug", "expires_at").join(graphs, "slug", "left_semi")


def _peers(spark, sf):
    n = table(spark, sf, "nation")
    e = lambda a, b: n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * a + b) % 25).alias("dst"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("slug"), F.when(F.col("n_nationkey") % 4 == 1, "2025-01-01").when(F.col("n_nationkey") % 4 == 2, "2027-01-01").alias("expires_at"))
    return e(3, 1).unionByName(e(7, 2))


def bfs(spark, sf):
    starts = table(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("start"))
    return g.reachable(starts, g.live_peers(_peers(spark, sf), "2026-01-01"), 3).filter("depth > 0")


def direct(spark, sf):
    return g.live_peers(_peers(spark, sf), "2026-01-01").select("src", "dst").distinct()


def listed(spark, sf):
    """Live edges with the region of their graph, if it has one."""
    r = table(spark, sf, "region").filter("r_regionkey < 3").select(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("slug"), F.col("r_name").alias("graph"))
    return g.live_peers(_peers(spark, sf), "2026-01-01").join(r, "slug", "left").select("src", "dst", "slug", "graph")


def orphans(spark, sf):
    graphs = table(spark, sf, "region").select(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("slug"))
    return g.without_peers(graphs, _peers(spark, sf).filter("expires_at is null and src < 3"))


QUERIES = {
    "paragraphs": paragraphs, "paragraphs_merged": merged, "sentences": sentences, "chunk_documents": chunks, "redact": redact, "excerpt_wrap": excerpts,
    "validate_entries": validation, "text_sizes": sizes, "branch_tokens": branches, "transcript_digest": digests, "compress_paragraphs": compress,
    "provenance_walk": provenance, "provenance_nodes": provenance_nodes, "peers_sweep": peers_swept, "peer_bfs": bfs, "peer_direct": direct, "peer_ttl_live": listed, "orphan_graphs": orphans,
}
_C = f"{d.SQL_ENTRY}, c as (select id, replace(content, chr(13) || chr(10), chr(10)) as content from e where content is not null)"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LISTED = "list_filter(list_transform({}, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
_SPLIT_P = _LISTED.format(r"string_split(regexp_replace(content, '\n(?:[^\S\n]*\n)+', chr(1), 'g'), chr(1))")
_SPLIT_S = _LISTED.format(r"string_split(regexp_replace(content, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1))")
_ESC = lambda s: "'" + s.replace("'", "''") + "'"
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_REDACTED = "tx"
for _p in t.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, {_ESC(_p)}, '<REDACTED>', 'g')"
_PEERS = """p0 as (select n_nationkey as src, n_regionkey, n_nationkey, unnest([(n_nationkey * 3 + 1) % 25, (n_nationkey * 7 + 2) % 25]) as dst from nation),
p as (select src, dst, 'g' || n_regionkey as slug, case when n_nationkey % 4 = 1 then '2025-01-01' when n_nationkey % 4 = 2 then '2027-01-01' end as expires_at from p0),
lp as (select * from p where expires_at is null or expires_at >= '2026-01-01')"""
_EDGES = f"{d.SQL_ENTRY}, {d.SQL_EVIDENCE}, ed as (select distinct entry_id as src, case when id like '7%' then 'gone-' || derived_from else derived_from end as dst from v where kind = 'derived' and derived_from is not null and entry_id is not null)"
SQL = {
    "paragraphs": f"with {_C}, x as (select id, {_SPLIT_P} as p from c) select id, len(p) as n, md5(array_to_string(p, chr(1))) as md5 from x",
    # A part's length; a part after one of fewer than 100 bytes joins it with two bytes between.
    "paragraphs_merged": f"""with {_C}, x as (select id, list_transform({_SPLIT_P}, lambda p: [octet_length(encode(p))::bigint]) as p from c)
        select id, case when len(p) = 0 then 0 else len(list_reduce(p, lambda a, b: case when a[len(a)] < 100 then list_append(a[:len(a) - 1], a[len(a)] + 2 + b[1]) else list_append(a, b[1]) end)) end as n from x""",
    "transcript_digest": rf"""with x as (select doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10) || chr(10), 'g'), '\n(\w+: )', chr(10) || chr(10) || '\1', 'g') || chr(10) || '---' || chr(10) || 'Bash(ls)' || chr(10) as x
          from documents where doc_type = 'transcript' and text is not null),
        p as (select doc_id, x, ({_LISTED.format("string_split(regexp_replace(x, '(?m)^[^\\S\\n]*(?:---)?[^\\S\\n]*$', chr(1), 'g'), chr(1))".replace(chr(92) * 2, chr(92)))})[1:500] as p from x),
        y as (select *, greatest(len(p) - 3, least(len(p), 3)) as k, array_to_string(list_filter(string_split(x, chr(10)), lambda l: {" or ".join(f"contains(l, {_ESC(m)})" for m in t.DIGEST_MARKS)}), chr(10)) as tools from p)
        select doc_id, len(p) as n_turns, sha256(concat_ws('|', 's' || doc_id, array_to_string(p[1:3], {_SEP}), array_to_string(p[k + 1:len(p)], {_SEP}), tools)) as hash from y""",
    "sentences": f"with {_C}, x as (select id, {_SPLIT_S} as p from c) select id, len(p) as n, md5(array_to_string(p, chr(1))) as md5 from x",
    "redact": f"with {_C}, x as (select id, content || ' ' || ([{', '.join(_ESC(s) for s in SECRET)}])[instr('0123456789abcdef', id[1]) % {len(SECRET)} + 1] as tx from c), y as (select id, {_REDACTED} as r from x) select id, md5(r) as md5, contains(r, 'REDACTED') as hit from y",
    "excerpt_wrap": f"""with {d.SQL_EVIDENCE}, x as (select id, citation_excerpt || case id[1] when 'a' then '<<END>>' when 'b' then chr(7) when 'c' then '<<<' else '' end as x from v where citation_excerpt is not null)
        select id, case when length(x) > 512 then 'too_long' when contains(x, '{t.OPEN}') or contains(x, '{t.CLOSE}') then 'envelope_marker' when contains(x, chr(7)) then 'control_character' end as problem,
        '{t.OPEN}' || replace(x, '<<', '<' || chr(8203) || '<') || '{t.CLOSE}' as wrapped from x""",
    "validate_entries": f"""with {d.SQL_ENTRY}, x as (select *, case id[1] when 'a' then list_append(tags, '') when 'b' then list_append(tags, repeat('é', 26)) else tags end as tg from e)
        select id, case when length(summary) > 60 then 'summary_too_long' when kind not in ('observation', 'belief', 'procedure', 'convention') then 'unknown_kind'
        when len(list_filter(tg, lambda z: z = '')) > 0 then 'empty_tag' when len(list_filter(tg, lambda z: octet_length(encode(z)) > 50)) > 0 then 'tag_too_long' end as problem from x""",
    "text_sizes": f"""with {d.SQL_ENTRY} select id, ((octet_length(encode(content)) + 3) // 4)::bigint as n_tokens, md5(split_part({_TRIM.format('content')}, chr(10) || chr(10), 1)) as first_md5,
        list_max(list_transform(range(0, 33), lambda k: case when octet_length(encode(left(summary, k))) <= 32 then lpad(k::varchar, 2, '0') || left(summary, k) end))[3:] as short, md5(left(content, 9500)) as clamped_md5 from e where content is not null""",
    "branch_tokens": rf"""with {d.SQL_ENTRY} select id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace('feat-' || left(id, 4) || '-' || path, '^[a-z]+-[a-z0-9]+-', ''), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: lower(w)), ' ') as words from e""",
    "provenance_walk": f"""with recursive {_EDGES}, r as (select distinct src as start, src as node from ed union select r.start, ed.dst from r join ed on ed.src = r.node),
        q as (select r.*, e.id as known, exists (select 1 from ed where ed.src = r.node) as up, exists (select 1 from ed where ed.src = r.node and ed.dst = r.start) as back from r left join (select id from e) e on e.id = r.node)
        select start, count(*) as n_nodes, count(*) filter (known is not null and not up) as n_roots, count(*) filter (known is null) as n_dangling, bool_or(back) as cycle from q group by start""",
    "provenance_nodes": f"""with recursive {_EDGES}, r as (select distinct src as start, src as node, 0 as depth from ed union select r.start, ed.dst, depth + 1 from r join ed on ed.src = r.node where depth < 3),
        q as (select start, node, min(depth) as depth from r group by 1, 2)
        select start, node, depth, case when node not in (select id from e) then 'dangling' when node not in (select src from ed) then 'root' when depth = 3 then 'cut' else 'inner' end as state from q""",
    "peers_sweep": """select n_nationkey as src, 'g' || n_nationkey as slug, x as expires_at from (select *, case when n_nationkey % 4 <> 0 then strftime(date '2025-01-01' + (n_nationkey % 3 * 365)::int, '%Y-%m-%d') end as x from nation)
        where x is null or x >= '2026-01-01'""",
    "peer_bfs": f"""with recursive {_PEERS}, r as (select n_nationkey as start, n_nationkey as node, 0 as depth from nation where n_nationkey % 5 = 0 union select start, dst, depth + 1 from r join lp on lp.src = node where depth < 3)
        select start, node, min(depth) as depth from r group by 1, 2 having min(depth) > 0""",
    "peer_direct": f"with {_PEERS} select distinct src, dst from lp",
    "peer_ttl_live": f"with {_PEERS} select src, dst, slug, r_name as graph from lp left join region on slug = 'g' || r_regionkey and r_regionkey < 3",
    "orphan_graphs": f"with {_PEERS} select 'g' || r_regionkey as slug from region where 'g' || r_regionkey not in (select slug from p where expires_at is null and src < 3)",
}
