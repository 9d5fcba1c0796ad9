"""Problem 2: near-duplicate entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidlake.llm.near import NearDuplicates, entry_texts
from evidlake.session import spread, table

#: As the problem is stated for this data: runs of three words, half of them shared.
WIDTH, LEAST = 3, 0.5


def _near(spark: SparkSession, sf: str) -> NearDuplicates:
    return NearDuplicates(entry_texts(spread(table(spark, sf, "entry_adds").select("id", "summary", "content"))), WIDTH, LEAST)


def found(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).pairs().select("id_a", "id_b")


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).groups()


QUERIES = {"p2_found": found, "p2_groups": groups}
_PAIRS = r"""tx as (select distinct id, coalesce(summary, '') || ' ' || coalesce(content, '') as text from entry_adds where id is not null),
n as (select row_number() over () as k, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from tx),
t as (select distinct k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as run from n where len(w) >= 3),
c as (select k, count(*) as n, md5(string_agg(run, chr(1) order by run)) as set_key from t group by k),
m as (select a.k as a, b.k as b, count(*) as both_ from t a join t b on a.run = b.run and a.k < b.k group by 1, 2),
p as (select x.id as id_1, y.id as id_2, ca.set_key as key_1, cb.set_key as key_2 from m join c ca on ca.k = a join c cb on cb.k = b join n x on x.k = a join n y on y.k = b where both_ >= 0.5 * (ca.n + cb.n - both_))"""
SQL = {
    "p2_found": f"with {_PAIRS} select distinct least(id_1, id_2) as id_a, greatest(id_1, id_2) as id_b from p where id_1 <> id_2",
    "p2_groups": f"""with recursive {_PAIRS}, e as (select id_1 as src, id_2 as dst, key_1 as own, key_2 as other from p union all select id_2, id_1, key_2, key_1 from p),
        r as (select distinct src as id, src as node from e union select r.id, e.dst from r join e on e.src = r.node)
        select id, min(node) as group_id, (select count(distinct other) from e where src = r.id and own <> other) as n_links from r group by id""",
}
