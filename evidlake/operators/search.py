"""Retrieval lanes and their fusion. Queries come as a table, so one job answers all of them.

Ranks are total: score descending, then id ascending by bytes. Scores are computed in double precision
and rounded only where a result leaves the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidlake.session import written

K1, B = 1.2, 0.75
#: Query vectors in one broadcast; more are taken in blocks, each of which reads the vectors once.
QUERY_BLOCK = 4096


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def live(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.coalesce(F.col("is_stale"), F.lit(False)))


def path_prefix(column: Column, prefix: str) -> Column:
    """Literal prefix match that ignores the case of ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.startswith(F.translate(column, upper, lower), F.translate(F.lit(prefix), upper, lower))


def ranked(df: DataFrame, by: list[str], score: str, k: int | None, name: str = "rank") -> DataFrame:
    """Rank within each group; with k, Catalyst cuts groups before the shuffle (WindowGroupLimit)."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), "id")).cast("bigint"))
    return out if k is None else out.filter(F.col(name) <= k)


# The most a request may ask for.
MOST = {"limit": 100, "verify_k": 100, "pool": 32}


def request(strict: bool = True, **asked: int) -> dict[str, int]:
    """A request's numbers within their limits: out of them, an error at the boundary (strict), else held to them."""
    out = {}
    for name, n in asked.items():
        least, most = 0 if name == "verify_k" else 1, MOST[name]
        if strict and not least <= n <= most:
            raise ValueError(f"{name} must be between {least} and {most}")
        out[name] = min(most, max(least, n))
    return out


def phrases(queries: DataFrame) -> DataFrame:
    """(qid, query) -> one row per token: qid, term (number of the white-space separated term), n, j, token.

    A term of several tokens is a phrase; terms without any token are left out."""
    terms = queries.select("qid", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("term", "t")).select("qid", "term", tokens(F.col("t")).alias("toks"))
    return terms.filter(F.size("toks") > 0).select("qid", "term", F.size("toks").alias("n"), F.posexplode("toks").alias("j", "token"))


#: So many different query tokens are told apart while a text is tokenized; more of them are joined.
FEW_TOKENS = 256


def small(df: DataFrame, name: str) -> DataFrame:
    """df for several readers: kept by the driver if it has at most 4 * QUERY_BLOCK rows, else written."""
    rows = df.limit(4 * QUERY_BLOCK + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= 4 * QUERY_BLOCK else written(df, name)


def tokens_of(columns: list[str]) -> Column:
    """Tokens of several text columns, with an empty one between columns, so that no phrase goes over a border."""
    parts = [tokens(F.coalesce(c, F.lit(""))) for c in columns]
    gap = F.array(F.lit(""))
    return parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (p, gap)][:-1])


def full_text(docs: DataFrame, queries: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(id, text columns) x (qid, query) -> qid, id, score: every document that holds all terms, with its BM25 score.

    Implicit AND of phrases; Okapi BM25 (k1 1.2, b 0.75) with ln(1 + (N - df + 0.5) / (df + 0.5)). Texts are tokenized
    once; of each its length and the occurrences of query tokens go on. Null texts count as empty.
    """
    q = small(phrases(queries), "phrases")
    want = [r[0] for r in q.select("token").distinct().limit(FEW_TOKENS + 1).collect()]
    # The length is a column of its own, so that exploded rows carry it and not the tokens.
    t = docs.select("id", tokens_of(list(columns)).alias("toks"))
    t = t.withColumn("len", F.size("toks") if len(columns) == 1 else F.size(F.filter("toks", lambda x: x != "")))
    if len(want) <= FEW_TOKENS:
        placed = F.transform("toks", lambda x, i: F.struct(i.alias("pos"), x.alias("token")))
        here = F.filter(placed, lambda x: F.array_contains(F.array(*map(F.lit, want)).cast("array<string>"), x["token"]))
        t = written(t.select("id", "len", here.alias("here")), "occurrences")
        found = t.select("id", "len", F.inline("here"))
    else:
        found = t.select("id", "len", F.posexplode("toks").alias("pos", "token"))
    return bm25(found, q, *t.agg(F.count("*"), F.avg("len")).first())


def bm25(found: DataFrame, q: DataFrame, n_docs: int, avg_len: float) -> DataFrame:
    """Occurrences (id, len, pos, token) and phrases of queries -> qid, id, score."""
    one = found.join(q.filter("n = 1"), "token").groupBy("qid", "term", "id", "len").agg(F.count("*").alias("tf"))
    phrase = (
        found.join(q.filter("n > 1"), "token")
        .groupBy("qid", "term", "n", "id", "len", (F.col("pos") - F.col("j")).alias("start")).agg(F.countDistinct("j").alias("m"))
        .filter("m = n")
        .groupBy("qid", "term", "id", "len").agg(F.count("*").alias("tf"))
    )
    hits = written(one.unionByName(phrase) if not q.filter("n > 1").isEmpty() else one, "hits")  # small, and read twice
    df = hits.groupBy("qid", "term").agg(F.count("*").alias("df"))
    need = q.groupBy("qid").agg(F.countDistinct("term").alias("n_terms"))
    tf, n, d = F.col("tf"), F.lit(n_docs), F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(avg_len or 1))))
    return (
        hits.join(df, ["qid", "term"])
        .groupBy("qid", "id").agg(F.sum(part).alias("score"), F.count("*").alias("m"))
        .join(need, "qid").filter("m = n_terms").select("qid", "id", "score")
    )


def tie_run(scored: DataFrame, k: int) -> DataFrame:
    """The first k and every further row that ties with the k-th."""
    return scored.withColumn("rank", F.rank().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)))).cast("bigint")).filter(F.col("rank") <= k)


#: Dimension of vectors that may be flagged as normalized.
NORMALIZED_DIM = 384


def _unit(rows: list, dim: int, ready: list | None = None) -> np.ndarray:
    """Vectors of length 1; 0 for those of another dimension, with non-finite values or of norm 0. Those that are
    ``ready`` and of NORMALIZED_DIM are taken as they are, so that their scores are plain dot products."""
    m = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        if v is not None and len(v) == dim:
            m[i] = v
    m[~np.isfinite(m).all(axis=1)] = 0
    if ready is not None and dim == NORMALIZED_DIM:
        rest = ~np.array([bool(x) for x in ready], bool)
        m[rest] = _unit(list(m[rest]), dim)
        return m
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _in_blocks(queries: DataFrame, of, flag: str | None = None) -> DataFrame | list:
    """The rows of the queries if they fit in one block, else the union of ``of`` over blocks."""
    rows = queries.select("qid", "embedding", *([flag] if flag else [])).limit(QUERY_BLOCK + 1).collect()
    if len(rows) <= QUERY_BLOCK:
        return rows
    parts = queries.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(-(-queries.count() // (QUERY_BLOCK // 2)))))
    out = None
    for r in parts.select("_b").distinct().collect():
        one = of(parts.filter(F.col("_b") == r["_b"]).drop("_b"))
        out = one if out is None else out.unionByName(one)
    return out


class _Best:
    """The best k rows per query of what came so far: score descending, then id; of rows of one id the first."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def add(self, scores: np.ndarray, key: np.ndarray, label: np.ndarray) -> None:
        """scores: queries x rows."""
        wide = min(scores.shape[1], self.k)
        if not wide:
            return
        floor = -np.partition(-scores, wide - 1, axis=1)[:, wide - 1]
        for i, row in enumerate(scores):
            if len(self.rows[i]) >= self.k and row.max() < self.rows[i][-1][0]:
                continue
            at = np.flatnonzero(row >= floor[i])
            if len(set(key[at])) < self.k:  # several rows of one id
                at = np.arange(len(row))
            best: dict = {}
            for x, y, z in sorted([*((row[j], key[j], label[j]) for j in at), *self.rows[i]], key=lambda r: (-r[0], r[2])):
                best.setdefault(y, (x, y, z))
            self.rows[i] = sorted(best.values(), key=lambda r: (-r[0], r[1]))[: self.k]


def similarities(vectors: DataFrame, queries: DataFrame, k: int | None = None, digits: int | None = None, label: str | None = None, flag: str | None = None) -> DataFrame:
    """(id, embedding) x (qid, embedding) -> qid, id, score: exact cosine similarity, rounded to ``digits``.

    0 for vectors of another length, with non-finite values or of norm 0; rows stay. Query vectors go out in
    blocks of QUERY_BLOCK. With k, a task gives only its own first k per query, ids once each; ``label``
    is a column that comes along, of several rows of an id that of the best (then the least label).
    ``flag`` is a boolean column of both sides: vectors it calls normalized need no norms.
    """
    rows = _in_blocks(queries, lambda part: similarities(vectors, part, k, digits, label, flag), flag)
    if not isinstance(rows, list):
        return rows
    qids, dim = [r.qid for r in rows], max((len(r.embedding or ()) for r in rows), default=0)
    q = _unit([r.embedding for r in rows], dim, [r[flag] for r in rows] if flag else None)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(qids), k) if k else None
        for df in batches:
            s, key = q @ _unit(df["embedding"].tolist(), dim, df[flag].tolist() if flag else None).T, df["id"].to_numpy()
            s = s if digits is None else np.round(s, digits)
            if best:
                best.add(s, key, df["label"].to_numpy() if label else np.zeros(len(df)))
            else:
                yield pd.DataFrame({"qid": np.repeat(qids, len(key)), "id": np.tile(key, len(qids)), "score": s.reshape(-1)})
        if best:
            out = [(qids[i], y, x, *([z] if label else [])) for i, rs in enumerate(best.rows) for x, y, z in rs]
            yield pd.DataFrame(out, columns=["qid", "id", "score", *(["label"] if label else [])])

    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    if label and k:
        out = vectors.select("id", "embedding", *([flag] if flag else []), F.col(label).alias("label")).mapInPandas(score, f"qid {kinds[0]}, id {kinds[1]}, score double, label {dict(vectors.dtypes)[label]}")
        return out.withColumnRenamed("label", label)
    return vectors.select("id", "embedding", *([flag] if flag else [])).mapInPandas(score, f"qid {kinds[0]}, id {kinds[1]}, score double")


def ranks_of(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, digits: int) -> DataFrame:
    """candidates (qid, id) -> qid, id, score, rank of those that have a vector, among all vectors.

    The candidates' own scores go out sorted; a task counts, for each, what is before it (score descending, then id) and
    gives one row per candidate. No query's scores are ever brought together. Candidates are few per query.
    """
    rows = _in_blocks(queries, lambda part: ranks_of(candidates, vectors, part, digits))
    if not isinstance(rows, list):
        return rows
    own = vectors.join(candidates.select("id").distinct(), "id", "left_semi")
    own = similarities(own, queries, None, digits).join(candidates.select("qid", "id"), ["qid", "id"], "left_semi").collect()  # as many as candidates
    dim = max((len(r.embedding or ()) for r in rows), default=0)
    q, number = _unit([r.embedding for r in rows], dim), {r.qid: i for i, r in enumerate(rows)}
    of: list[list[tuple]] = [[] for _ in rows]
    for r in own:
        of[number[r.qid]].append((r.score, r.id))
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(([np.array([x for x, _ in c]) for c in of], [[y for _, y in c] for c in of]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, ids = shared.value
        n = [np.zeros(len(c), np.int64) for c in scores]
        for df in batches:
            s, key = np.round(q @ _unit(df["embedding"].tolist(), dim).T, digits), df["id"].to_numpy()
            for i, c in enumerate(scores):
                if len(c):
                    up = np.sort(s[i])
                    lo, hi = np.searchsorted(up, c), np.searchsorted(up, c, side="right")
                    n[i] += len(up) - hi
                    for j in np.flatnonzero(hi > lo):  # equal scores: by id
                        n[i][j] += int((key[s[i] == c[j]] < ids[i][j]).sum())
        out = [(rows[i].qid, y, float(x), int(k)) for i in range(len(rows)) for x, y, k in zip(scores[i], ids[i], n[i], strict=True)]
        yield pd.DataFrame(out, columns=["qid", "id", "score", "n"])

    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    counts = vectors.select("id", "embedding").mapInPandas(count, f"qid {kinds[0]}, id {kinds[1]}, score double, n bigint")
    return counts.groupBy("qid", "id").agg(F.first("score").alias("score"), (F.sum("n") + 1).alias("rank"))


def fuse(text: DataFrame, semantic: DataFrame, cues: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (60 + rank) over lanes of (qid, id, rank).

    Candidates are the text lane's first ``limit``, the semantic and the cue lane's first 2 * limit; a candidate
    gets the semantic part whatever its rank. ``source`` is the first lane that brought it.
    """
    lanes = (
        text.filter(F.col("rank") <= limit).select("qid", "id", "rank", F.lit(0).alias("lane"))
        .unionByName(semantic.select("qid", "id", "rank", F.lit(1).alias("lane")))
        .unionByName(cues.filter(F.col("rank") <= 2 * limit).select("qid", "id", "rank", F.lit(2).alias("lane")))
    )
    brings = F.when((F.col("lane") != 1) | (F.col("rank") <= 2 * limit), F.col("lane"))
    return (
        lanes.groupBy("qid", "id").agg(F.sum(1 / (60 + F.col("rank"))).alias("score"), F.min(brings).alias("first"))
        .filter("first is not null")
        .select("qid", "id", "score", F.element_at(F.array(F.lit("fts"), F.lit("semantic"), F.lit("cue")), F.col("first") + 1).alias("source"))
    )


def decayed(scored: DataFrame, updated_at: str, as_of: str, rate: float) -> DataFrame:
    """score * exp(-rate * days). Only times written ``yyyy-MM-dd HH:mm:ss`` decay, any other has age 0."""
    t = F.when(F.col(updated_at).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.unix_micros(F.concat(F.col(updated_at), F.lit("Z")).try_cast("timestamp")))
    days = F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(F.lit(as_of).cast("timestamp")) - t) / 86_400_000_000, F.lit(0.0)))
    return scored.withColumn("score", F.col("score") * F.exp(-rate * days))


def mmr_order(scores: list[float], vectors: list, ids: list, balance: float, limit: int) -> list[int]:
    """Greedy maximal marginal relevance over one pool; missing vectors have similarity 0 to all."""
    balance, top = min(1.0, max(0.0, balance)), max(scores, default=0.0)
    dim = max((len(v) for v in vectors if v is not None), default=0)
    m = np.zeros((len(scores), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim and np.linalg.norm(v) > 0:
            m[i] = np.asarray(v, float) / np.linalg.norm(v)
    sim = m @ m.T
    left = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))
    out: list[int] = []
    while left and len(out) < limit:
        if not out:
            i = left[0]
        else:
            worth = {i: balance * (scores[i] / top if top > 0 else 0.0) - (1 - balance) * max(0.0, *(float(sim[i, j]) for j in out)) for i in left}
            i = min(left, key=lambda i: (-worth[i], -scores[i], ids[i]))
        out.append(i)
        left.remove(i)
    return out


def diversified(pool: DataFrame, vectors: DataFrame, balance: float, limit: int) -> DataFrame:
    """MMR per query over a pool of at most 2 * limit rows (qid, id, score); scores don't change."""
    own = ranked(pool, ["qid"], "score", 2 * limit).join(vectors.select("id", "embedding"), "id", "left").select("qid", "id", "score", "embedding")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        o = mmr_order(pdf["score"].tolist(), pdf["embedding"].tolist(), pdf["id"].tolist(), balance, limit)
        return pdf.iloc[o][["qid", "id", "score"]].assign(rank=range(1, len(o) + 1))

    kinds = dict(pool.dtypes)
    return own.groupBy("qid").applyInPandas(pick, f"qid {kinds['qid']}, id {kinds['id']}, score double, rank bigint")


def federated(rows: DataFrame, limit: int) -> DataFrame:
    """Results of several repositories (qid, id, score, origin, is_local) as one list: of rows with one id the
    local, else the better stands; score descending, local first, origin, id; cut once."""
    one = W.partitionBy("qid", "id").orderBy(F.desc("is_local"), F.desc("score"), "origin")
    best = rows.withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k")
    w = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("is_local"), "origin", "id")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)


def expanded(entries: DataFrame, seeds: DataFrame, evidence: DataFrame, max_seeds: int = 32) -> DataFrame:
    """Neighbours of the seeds (id), one point each for the same folder, a shared tag, cue or cited file.

    entries: id, path, tags, cues, is_stale. Only live seeds count, at most ``max_seeds``; without any
    the result is empty. id, facets; seeds and stale entries are left out.
    """
    e = live(entries).select("id", F.regexp_extract("path", r"^(.*)/", 1).alias("dir"), "tags", "cues")
    s = e.join(seeds.select("id").distinct(), "id", "left_semi").orderBy("id").limit(max_seeds)
    cites = evidence.filter("citation_path is not null").select(F.col("entry_id").alias("id"), F.regexp_replace("citation_path", r":[^:]*$", "").alias("file")).distinct()
    facets = []
    for name, col in (("dir", F.array("dir")), ("tag", F.col("tags")), ("cue", F.col("cues"))):
        of = lambda df, col=col: df.select("id", F.explode(col).alias("v")).filter("v is not null").distinct()
        facets.append(of(e).join(of(s).select("v").distinct(), "v", "left_semi").select("id").distinct().withColumn("facet", F.lit(name)))
    seed_files = cites.join(F.broadcast(s.select("id")), "id", "left_semi").select("file").distinct()
    facets.append(cites.join(seed_files, "file", "left_semi").select("id").distinct().withColumn("facet", F.lit("file")))
    points = facets[0].unionByName(facets[1]).unionByName(facets[2]).unionByName(facets[3])
    return points.groupBy("id").agg(F.count("*").alias("facets")).join(F.broadcast(s.select("id")), "id", "left_anti").join(e.select("id"), "id", "left_semi")


def greedy_pack(sizes: list[int], budget: int) -> list[bool]:
    """Takes whole items in order while they fit; one that doesn't is skipped and the walk goes on."""
    out = []
    for s in sizes:
        ok = s <= budget
        out.append(ok)
        budget -= s if ok else 0
    return out


def context_candidates(entries: DataFrame, evidence: DataFrame, files: list[str], hits: DataFrame, floor: float | None = None) -> DataFrame:
    """id, overlap (cited files in the working set over all citations), fts (1 / (60 + rank)), score, n_tokens.

    hits: id, rank. Kept: a score of ``floor`` or more, without one any signal at all."""
    file = F.regexp_replace("citation_path", r":\d+-\d+$", "")
    c = evidence.filter("citation_path is not null").dropDuplicates(["id"]).groupBy(F.col("entry_id").alias("id")).agg(F.avg(file.isin(files).cast("double")).alias("overlap"))
    n = F.ceil((F.octet_length("summary") + F.octet_length("content")) / 4).cast("bigint")
    return (
        live(entries).select("id", n.alias("n_tokens"))
        .join(c, "id", "left").join(hits.select("id", (1 / (60 + F.col("rank"))).alias("fts")), "id", "left")
        .fillna(0.0, ["overlap", "fts"]).withColumn("score", F.col("overlap") + F.col("fts")).filter("score > 0" if floor is None else F.col("score") >= floor)
    )


def context_pack(candidates: DataFrame, budget: int, pool: int = 10_000) -> DataFrame:
    """Greedy pack of the candidates (id, score, n_tokens; one row per id) into a token budget: whole ones in rank order while they fit.

    All candidates count, in blocks of the next ``pool`` that still fit. The first of a block always fits, so every block
    uses budget; those without a token fit anyway and take no part in the walk, so at most ``budget`` rows are fetched and kept.
    """
    c = written(candidates, "candidates")  # small, and every block must see the same scores
    rest, kept = c.filter("n_tokens > 0"), []
    while True:
        block = rest.filter(F.col("n_tokens") <= budget).orderBy(F.desc("score"), "id").limit(pool).collect()
        for r, ok in zip(block, greedy_pack([r.n_tokens for r in block], budget), strict=True):
            if ok:
                kept.append(r)
                budget -= r.n_tokens
        if len(block) < pool:
            break
        last = block[-1]
        rest = c.filter("n_tokens > 0").filter((F.col("score") < last.score) | ((F.col("score") == last.score) & (F.col("id") > last.id)))
    free = c.filter((F.col("n_tokens") == 0) & F.lit(budget >= 0))
    return c.sparkSession.createDataFrame(kept, c.schema).unionByName(free)
