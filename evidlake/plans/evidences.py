"""Evidence queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidlake.functions import citations as c
from evidlake.operators import evidence as ev
from evidlake.plans import domain as d
from evidlake.session import table

#: The given evidence cites files nobody has, so files and citations are made from documents:
#: document n is docs/n.md; its citation is whole, a range, broken or escaping by n modulo 8.


def _n():
    return F.col("doc_id")


def files(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select(F.concat(F.lit("docs/"), _n().cast("string"), F.lit(".md")).alias("file"), F.encode("text", "UTF-8").alias("content"), "text")


def made_evidence(spark, sf):
    t = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    size = F.length("b").cast("bigint")
    path = F.concat(F.lit("docs/"), _n().cast("string"), F.lit(".md"))
    m = _n() % 8
    cite = (
        F.when(m == 0, F.concat(path, F.lit(":0-"), size.cast("string"))).when(m == 1, F.concat(path, F.lit(":10-90"))).when(m == 2, F.concat(path, F.lit(":90-10")))
        .when(m == 3, F.concat(F.lit("../"), path)).when(m == 4, F.concat(path, F.lit("x"))).when((m == 5) & (_n() % 3 == 0), F.lit(None)).when(m == 6, F.concat(path, F.lit(":0-"), (size + 5).cast("string"))).otherwise(path)
    )
    h = F.when(m == 1, F.sha2(c.sliced(F.col("b"), F.lit(10), F.lit(90)), 256)).otherwise(F.sha2("b", 256))
    h = F.when(_n() % 5 == 0, F.concat(F.lit("sha256:"), F.upper(h))).when(_n() % 11 == 0, F.lit("00")).otherwise(h)
    return t.select(F.concat(F.lit("ev"), _n().cast("string")).alias("id"), F.concat(F.lit("en"), (_n() % 97).cast("string")).alias("entry_id"), F.when(_n() % 13 == 0, "test").otherwise("code").alias("kind"), cite.alias("citation_path"), h.alias("citation_hash"))


def parse(spark, sf):
    p = c.parsed(F.col("citation_path"))
    v = d.evidence(spark, sf).select("id", "citation_path", p.alias("p"))
    return v.select("id", "p.file", "p.start", "p.stop", "p.reason", c.formatted(F.col("p.file"), F.col("p.start"), F.col("p.stop")).alias("again"), c.file_any_colon(F.col("citation_path")).alias("any_colon"), c.file_digits(F.col("citation_path")).alias("digits"), c.file_dashed_digits(F.col("citation_path")).alias("dashed"))


def budget(spark, sf):
    """Bytes of the ranges an entry cites, and whether they exceed a budget (here 1,000 bytes)."""
    v = d.evidence(spark, sf).select("entry_id", c.parsed(F.col("citation_path")).alias("p"))
    return v.groupBy("entry_id").agg(F.coalesce(F.sum(F.col("p.stop") - F.col("p.start")), F.lit(0)).alias("bytes")).withColumn("skip", F.col("bytes") > 1000)


def cap(spark, sf):
    return ev.capped(d.evidence(spark, sf)).select("entry_id", "id", "n", "over")


def get(spark, sf):
    """Every live entry with its evidence."""
    j = ev.with_evidence(d.entries(spark, sf).filter("not is_stale"), d.evidence(spark, sf))
    return j.select("id", "path", F.coalesce(F.array_join(F.transform("evidence", lambda x: x["id"]), ","), F.lit("")).alias("evidence_ids"))


def verify(spark, sf):
    return ev.verified(made_evidence(spark, sf), files(spark, sf)).select("id", "status", "reason")


def cite(spark, sf):
    """Hash and size of whole files."""
    return files(spark, sf).select("file", F.sha2("content", 256).alias("hash"), F.length("content").cast("bigint").alias("size"))


def cited(spark, sf):
    """Citing entries of the first cited file whose name ends in ``.md``; kinds stand for statuses."""
    v = d.evidence(spark, sf).filter("citation_path is not null").withColumn("status", F.when(F.col("kind") == "command", "verified").when(F.col("kind") == "test", "relocated").otherwise("unverified"))
    file = v.agg(F.min(F.when(F.endswith(c.file_digits(F.col("citation_path")), F.lit(".md")), c.file_digits(F.col("citation_path"))))).first()[0]
    return ev.cited_by(d.entries(spark, sf), v, file)


def relocate(spark, sf):
    """Each excerpt is 90 characters of a document from its 21st on, looked for in all documents."""
    x = files(spark, sf).select(F.col("file").alias("id"), F.substring("text", 21, 90).alias("excerpt"), F.regexp_extract("file", r"(\d+)", 1).cast("bigint").alias("n")).filter("n % 100 = 0").drop("n")
    return ev.relocated(x, files(spark, sf))


def heal(spark, sf):
    return ev.healable(made_evidence(spark, sf), files(spark, sf))


def _commits(spark, sf):
    """Line items are commits to the file of their order's customer, by order date; a third of the orders has none."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("sha"), F.unix_micros(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").cast("timestamp")).alias("ord"), F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("file")).distinct()


def _order_entries(spark, sf):
    """Every order is an entry (path: customer, version_ref: order)."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").cast("string").alias("version_ref"))


def _changed(spark):
    return spark.range(1, 40).select(F.concat(F.lit("c/"), (F.col("id") * 7).cast("string")).alias("file"))


def stale(spark, sf):
    return ev.stale_by_commits(_order_entries(spark, sf), _changed(spark), _commits(spark, sf))


def touched(spark, sf):
    """Second pass by the commits that touched changed files: entries the first pass has not seen."""
    cm = _commits(spark, sf)
    e = _order_entries(spark, sf).withColumn("version_ref", F.when(F.col("id").cast("bigint") % 5 == 0, (F.col("id").cast("bigint") + 1).cast("string")).otherwise(F.col("version_ref")))
    refs = ev.touching(cm, _changed(spark)).unionByName(spark.createDataFrame([("6",), ("nowhere",)], "sha string"))
    return ev.review_by_refs(e, refs, cm, ev.stale_by_commits(e, _changed(spark), cm))


def _moved(spark, sf):
    """Evidence whose citations mostly no longer hold: document n is cited by hash of something else, with 90 of its characters as excerpt;
    by n modulo 4 in its own file, in that of document n + 1, as a range, or with a weak excerpt."""
    t = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    path = lambda n: F.concat(F.lit("docs/"), n.cast("string"), F.lit(".md"))
    m = _n() % 4
    cite = F.when(m == 1, path(_n() + 1)).when(m == 2, F.concat(path(_n()), F.lit(":0-40"))).otherwise(path(_n()))
    return t.select(
        F.concat(F.lit("ev"), _n().cast("string")).alias("id"), F.concat(F.lit("en"), (_n() % 97).cast("string")).alias("entry_id"), F.lit("code").alias("kind"), cite.alias("citation_path"),
        F.when(_n() % 9 == 0, F.sha2(F.encode("text", "UTF-8"), 256)).otherwise(F.lit("00")).alias("citation_hash"), F.substr("text", F.lit(21), F.when(m == 3, 20).otherwise(90)).alias("citation_excerpt"),
    )


def _policy(policy):
    def run(spark, sf):
        return ev.relocations(_moved(spark, sf), files(spark, sf), policy).select("id", "status", "reason", "new_path")

    return run


def pass3(spark, sf):
    """Third pass: evidence of every tenth entry (en0, en10, ...), searched in the cited file."""
    s = spark.range(0, 97, 10).select(F.concat(F.lit("en"), F.col("id").cast("string")).alias("id"))
    return ev.surfaced_relocations(s, _moved(spark, sf), files(spark, sf), ev.FILE_ONLY).select("id", "entry_id", "status", "reason", "new_path")


def healed_again(spark, sf):
    """Heals that hold when checked again; entries en0 to en9 are stale by then."""
    v, f = _moved(spark, sf), files(spark, sf)
    e = spark.range(97).select(F.concat(F.lit("en"), F.col("id").cast("string")).alias("id"), (F.col("id") < 10).alias("is_stale"))
    return ev.confirmed_heals(ev.relocations(v, f, ev.FILE_ONLY), v, e, f, "2026-01-01T00:00:00Z", ev.FILE_ONLY).select("evidence_id", "entry_id", "old_path", "new_path", "citation_hash")


def review(spark, sf):
    """Entries made at a version that some live memory entry was made at."""
    e = d.entries(spark, sf)
    return ev.review_by_refs(e, e.filter("kind = 'memory' and not is_stale and version_ref is not null").select(F.col("version_ref").alias("sha")))


QUERIES = {
    "citation_parse": parse, "citation_budget": budget, "evidence_cap_per_entry": cap, "entry_get": get, "verify_evidence": verify, "cite_files": cite,
    "cited_by": cited, "relocate_excerpt": relocate, "migrate_citations": heal, "stale_check_commits": stale, "stale_check_refs": review, "stale_check_touched": touched,
    "verify_never": _policy(ev.NEVER), "relocate_file_only": _policy(ev.FILE_ONLY), "relocate_file_then_repo": _policy(ev.REPO), "stale_check_relocations": pass3, "heal_confirmed": healed_again,
}
_PARSE = r"""case when citation_path is null then 'missing_citation_path' when contains(citation_path, ':') and not coalesce(regexp_matches(citation_path, ':\d{1,18}-\d{1,18}$') and
  try_cast(regexp_extract(citation_path, ':(\d+)-\d+$', 1) as bigint) < try_cast(regexp_extract(citation_path, '-(\d+)$', 1) as bigint), false) then 'malformed_citation' end"""
_PARTS = rf"""q as (select *, {_PARSE} as reason0 from {{}}),
p as (select *, case when reason0 is null then regexp_replace(citation_path, ':\d+-\d+$', '') end as file,
  case when reason0 is null and contains(citation_path, ':') then regexp_extract(citation_path, ':(\d+)-\d+$', 1)::bigint end as start,
  case when reason0 is null and contains(citation_path, ':') then regexp_extract(citation_path, '-(\d+)$', 1)::bigint end as stop from q)"""
_FILES = "f as (select 'docs/' || doc_id || '.md' as file, encode(text) as content, text, octet_length(encode(text)) as size, hex(encode(text)) as hx, doc_id from documents where text is not null)"
_MADE = """m as (select 'ev' || doc_id as id, 'en' || (doc_id % 97) as entry_id, case when doc_id % 13 = 0 then 'test' else 'code' end as kind,
  case when doc_id % 8 = 0 then file || ':0-' || size when doc_id % 8 = 1 then file || ':10-90' when doc_id % 8 = 2 then file || ':90-10' when doc_id % 8 = 3 then '../' || file
    when doc_id % 8 = 4 then file || 'x' when doc_id % 8 = 5 and doc_id % 3 = 0 then null when doc_id % 8 = 6 then file || ':0-' || (size + 5) else file end as citation_path,
  case when doc_id % 5 = 0 then 'sha256:' || upper(h) when doc_id % 11 = 0 then '00' else h end as citation_hash
  from (select *, case when doc_id % 8 = 1 then case when size >= 90 then sha256(unhex(substr(hx, 21, 160))) end else sha256(content) end as h from f))"""
_VERIFIED = """j as (select p.id, p.entry_id, p.citation_path, p.file, start, stop, size, text, coalesce(reason0, case when p.file like '../%' then 'path_escape' when f.file is null then 'file_missing'
        when kind <> 'code' then 'not_code_kind' when stop > size then 'range_out_of_bounds'
        when (case when start is null then sha256(content) else sha256(unhex(substr(hx, 2 * start + 1, 2 * (stop - start)))) end) = lower(replace(citation_hash, 'sha256:', '')) then null else 'hash_mismatch' end) as reason
        from p left join f on p.file = f.file)"""
_MOVED = """m as (select 'ev' || doc_id as id, 'en' || (doc_id % 97) as entry_id, 'code' as kind, case doc_id % 4 when 1 then 'docs/' || (doc_id + 1) || '.md' when 2 then file || ':0-40' else file end as citation_path,
  case when doc_id % 9 = 0 then sha256(content) else '00' end as citation_hash, case when doc_id % 4 = 3 then substr(text, 21, 20) else substr(text, 21, 90) end as ex from f)"""


def _relocated(allowed: str) -> str:
    """CTEs up to ``r``; allowed says where a hit ``h`` counts."""
    return f"""{_FILES}, {_MOVED}, {_PARTS.replace('{}', 'm')}, {_VERIFIED},
  v as (select j.*, m.ex, m.citation_hash, reason in ('hash_mismatch', 'range_out_of_bounds') as look, octet_length(encode(m.ex)) >= 64 and contains(m.ex, chr(10)) as strong from j join m using (id)),
  h0 as (select v.id, v.file as cited, f.file, f.text, ex, instr(f.text, ex) as at_, contains(substr(f.text, instr(f.text, ex) + 1), ex) as more from v join f on contains(f.text, ex) where look and strong),
  h as (select id, count(*) + sum(more::int) as n, min(file) as file, min_by(octet_length(encode(substr(text, 1, at_ - 1))), file) as at_ from h0 h where {allowed} group by id),
  w as (select v.*, h.n, g.size as there, h.file || case when start is null then '' else ':' || h.at_ || '-' || (h.at_ + stop - start) end as path, h.at_ + stop - start as till from v left join h using (id) left join f g on g.file = h.file),
  r0 as (select *, case when not coalesce(look, false) then reason when not strong then case when reason = 'hash_mismatch' then 'excerpt_too_weak' else reason end when n is null then 'no_candidate' when n > 1 then 'non_unique'
    when start is not null and till > there then 'range_out_of_bounds' when path = citation_path then reason end as why from w),
  r as (select id, entry_id, citation_path, citation_hash, case when look and why is null then 'relocated' when reason is null then 'verified' else 'unverified' end as status, why as reason, case when look and why is null then path end as new_path from r0)"""


SQL = {
    "citation_parse": rf"""with {d.SQL_EVIDENCE}, {_PARTS.replace('{}', 'v')} select id, file, start, stop, reason0 as reason, case when start is null then file else file || ':' || start || '-' || stop end as again,
        regexp_replace(citation_path, ':[^:]*$', '') as any_colon, regexp_replace(citation_path, ':\d+-\d+$', '') as digits, regexp_replace(citation_path, ':\d+(-\d+)*$', '') as dashed from p""",
    "citation_budget": f"with {d.SQL_EVIDENCE}, {_PARTS.replace('{}', 'v')} select entry_id, coalesce(sum(stop - start), 0)::bigint as bytes, coalesce(sum(stop - start), 0) > 1000 as skip from p group by entry_id",
    "evidence_cap_per_entry": f"""with {d.SQL_EVIDENCE}, x as (select entry_id, id, row_number() over (partition by entry_id order by recorded_at nulls first, id) as n, count(*) over (partition by entry_id) > 200 as over from v)
        select entry_id, id, n, over from x where n <= 200""".replace(" as over from v", " as over_ from v").replace("n, over from x", "n, over_ as \"over\" from x"),
    "entry_get": f"""with {d.SQL_ENTRY}, {d.SQL_EVIDENCE} select e.id, e.path, coalesce(x.ids, '') as evidence_ids from e left join
        (select entry_id, string_agg(id, ',' order by recorded_at nulls first, id) as ids from v group by entry_id) x on x.entry_id = e.id where not is_stale""",
    "verify_evidence": f"""with {_FILES}, {_MADE}, {_PARTS.replace('{}', 'm')}, {_VERIFIED} select id, case when reason is null then 'verified' else 'unverified' end as status, reason from j""",
    "cite_files": f"with {_FILES} select file, sha256(content) as hash, size::bigint as size from f",
    "cited_by": rf"""with {d.SQL_ENTRY}, {d.SQL_EVIDENCE}, s as (select *, case kind when 'command' then 'verified' when 'test' then 'relocated' else 'unverified' end as status, case kind when 'command' then 2 when 'test' then 1 else 0 end as r from v where citation_path is not null),
        t as (select min(regexp_replace(citation_path, ':\d+-\d+$', '')) as file from s where regexp_replace(citation_path, ':\d+-\d+$', '') like '%.md'),
        x as (select s.*, row_number() over (partition by entry_id order by r, citation_path, id) as k, count(*) over (partition by entry_id) as n from s, t where citation_path = file or starts_with(citation_path, file || ':'))
        select entry_id, e.path, n as n_citations, status, x.id as evidence_id from x join e on e.id = entry_id where k = 1 and not is_stale""",
    "relocate_excerpt": f"""with {_FILES}, x as (select file as id, substr(text, 21, 90) as ex from f where doc_id % 100 = 0),
        a as (select id, ex, octet_length(encode(ex)) >= 64 and contains(ex, chr(10)) as able from x),
        h as (select a.id, f.file, instr(f.text, ex) as at_, f.text, ex, contains(substr(f.text, instr(f.text, ex) + 1), ex) as more from a join f on contains(f.text, ex) where able),
        n as (select id, count(*) + sum(more::int) as n, min(file) as file, min(octet_length(encode(substr(text, 1, at_ - 1)))) as start from h group by id)
        select a.id, case when n = 1 then 'relocated' else 'unverified' end as status, case when not able then 'excerpt_too_short' when n is null then 'no_candidate' when n > 1 then 'non_unique' else 'unique' end as reason,
        case when n = 1 then n.file end as file, case when n = 1 then start::bigint end as start from a left join n on n.id = a.id""",
    "migrate_citations": f"""with {_FILES}, {_MADE}, {_PARTS.replace('{}', 'm')}, j as (select p.id, p.file, case when start <> 0 then 'skipped:not_whole_file' when f.file is null then 'skipped:missing_file' when stop <> size then 'failed:size_mismatch'
        when sha256(content) <> lower(replace(citation_hash, 'sha256:', '')) then 'failed:hash_mismatch' else 'would_heal:' end as o from p left join f on p.file = f.file where start is not null)
        select id, split_part(o, ':', 1) as outcome, nullif(split_part(o, ':', 2), '') as reason, case when o = 'would_heal:' then file end as new_path from j""",
    "stale_check_commits": """with en as (select o_orderkey::varchar as id, 'c/' || o_custkey as path, o_orderkey::varchar as version_ref from orders),
        cm as (select distinct o_orderkey::varchar as sha, epoch_us(o_orderdate) as ord, 'c/' || o_custkey as file from lineitem join orders on l_orderkey = o_orderkey where o_orderkey % 3 <> 0),
        ch as (select 'c/' || (7 * i) as file from range(1, 40) t(i)),
        s as (select * from en where exists (select 1 from ch where contains(path, file) or ends_with(file, path))),
        r as (select s.*, c.ord as ref_ord from s left join (select sha, min(ord) as ord from cm group by sha) c on c.sha = version_ref),
        n as (select r.id, ref_ord, count(distinct case when cm.ord > ref_ord then sha end) as n_commits from r left join cm on cm.file = r.path group by all)
        select id, case when ref_ord is null then 'unreachable' when n_commits > 0 then 'stale' else 'fresh' end as bucket, case when ref_ord is not null then n_commits end as n_commits from n""",
    "stale_check_refs": f"with {d.SQL_ENTRY} select id, 'review' as bucket from e where version_ref in (select version_ref from e where kind = 'memory' and not is_stale and version_ref is not null)",
    "stale_check_touched": """with en as (select o_orderkey::varchar as id, 'c/' || o_custkey as path, case when o_orderkey % 5 = 0 then o_orderkey + 1 else o_orderkey end::varchar as version_ref from orders),
        cm as (select distinct o_orderkey::varchar as sha, 'c/' || o_custkey as file from lineitem join orders on l_orderkey = o_orderkey where o_orderkey % 3 <> 0),
        ch as (select 'c/' || (7 * i) as file from range(1, 40) t(i)), refs as (select sha from cm where file in (select file from ch) union select '6' union select 'nowhere')
        select id, case when version_ref in (select sha from cm) then 'review' else 'unreachable' end as bucket from en where version_ref in (select sha from refs)
        and not exists (select 1 from ch where contains(path, file) or ends_with(file, path))""",
    "verify_never": f"with {_FILES}, {_MOVED}, {_PARTS.replace('{}', 'm')}, {_VERIFIED} select id, case when reason is null then 'verified' else 'unverified' end as status, reason, null::varchar as new_path from j",
    "relocate_file_only": f"with {_relocated('h.file = cited')} select id, status, reason, new_path from r",
    "relocate_file_then_repo": f"with {_relocated('true')} select id, status, reason, new_path from r",
    "stale_check_relocations": f"with {_relocated('h.file = cited')} select id, entry_id, status, reason, new_path from r where status <> 'verified' and entry_id in (select 'en' || i from range(0, 97, 10) t(i))",
    "heal_confirmed": f"with {_relocated('h.file = cited')} select id as evidence_id, entry_id, citation_path as old_path, new_path, citation_hash from r where status = 'relocated' and entry_id not in (select 'en' || i from range(10) t(i))",
}
