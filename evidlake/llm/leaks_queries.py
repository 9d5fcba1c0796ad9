"""Problem 8: evaluation passages inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.llm import leaks as l
from evidlake.llm.leaks import leaks
from evidlake.session import spread, table

LEAST = 12


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items"), LEAST)


def found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).filter(F.col("n_words") >= LEAST).select("doc_id", "item_id").distinct()


def report(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation suite and split: items that leaked, documents that hold any, longest run; and documents that hold
    one only with words exchanged."""
    suites = table(spark, sf, "eval_items").select("item_id", "suite", "split")
    exact = F.col("n_words") >= LEAST
    return _leaks(spark, sf).join(suites, "item_id").groupBy("suite", "split").agg(
        F.countDistinct(F.when(exact, F.col("item_id"))).alias("n_items"),
        F.countDistinct(F.when(exact, F.col("doc_id"))).alias("n_documents"),
        F.max("n_words").alias("longest"),
        F.countDistinct(F.when(~exact, F.col("doc_id"))).alias("n_near_documents"),
    )


QUERIES = {"p8_found": found, "p8_report": report}


def _clean(column: str) -> str:
    """Words of a text without markup, entities and invisible characters, as the operator has them."""
    quoted = lambda p: "'" + p.pattern.replace("'", "''") + "'"
    x = f"regexp_replace({column}, {quoted(l._INVISIBLE)}, '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {quoted(l._BREAKING)}, ' ', 'gi'), {quoted(l._TAG)}, '', 'gs')"
    return rf"regexp_extract_all(lower(regexp_replace({x}, {quoted(l._ENTITY)}, ' ', 'g')), '[\p{{L}}\p{{N}}]+')"


#: A document holds an item's window if its letters hold the window's, from one edge of a word to another (the first place counts).
SQL = {
    "p8_found": f"""with dw as (select doc_id, {_clean("text")} as w from documents where text is not null),
        de as (select doc_id, list(at_) as edges from (select doc_id, sum(len(x)) over (partition by doc_id order by i) as at_ from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from dw)) group by doc_id),
        dl as (select dw.doc_id, array_to_string(w, '') as letters, list_prepend(0, edges) as edges from dw join de using (doc_id)),
        iw as (select item_id, {_clean("text")} as w from eval_items),
        win as (select distinct item_id, array_to_string(w[q:q + {LEAST - 1}], '') as letters from (select item_id, w, unnest(range(1, len(w) - {LEAST - 2})) as q from iw)),
        hit as (select doc_id, item_id, edges, instr(dl.letters, win.letters) as at_, len(win.letters) as n from dl join win on contains(dl.letters, win.letters))
        select distinct doc_id, item_id from hit where list_contains(edges, at_ - 1) and list_contains(edges, at_ - 1 + n)""",
}
