"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization.

The classifier looks at sentences. It is trained from labelled documents (complement naive Bayes: a word's weight for a
subject is the negative logarithm of its rate outside the subject, less that of its rate outside the sentences of
no subject, which are a class of their own), then refined over
every sentence of the corpus by expectation-maximization, so that words no labelled document has, in any
language, get weights too. A document's share of a subject is the share of its sentences that treat it;
a logistic curve fitted on the labelled documents turns shares into calibrated, independent posteriors, and a
document has the subjects whose posterior is a half or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.words import Hashes
from evidlake.session import written

#: Words are hashed to so many numbers; the model then holds only those that say something.
BUCKETS = 1 << 22
#: At most so many labelled documents train the first model (those with the least hash of doc_id).
MAX_LABELLED = 20_000
#: EM rounds over the whole corpus.
ROUNDS = 3
#: Score of a sentence that treats no subject.
NONE = 1.5
#: Occurrences that every word has besides those counted.
SMOOTH = 0.1
#: Factor of the weights. Complements differ little between subjects, so that sums of plain weights leave sentences
#: between subjects; few labels (the rarer languages) are then lost in the first round.
SHARP = 6.0
#: A word counts if at least this share of its (rate-corrected) occurrences, shrunk by so many, lies in one subject.
GATE, SHRINK = 0.45, 3
#: A document has the subjects of at least this calibrated posterior.
LEAST_POSTERIOR = 0.5
#: Weight, in labelled documents, of what the problem states about shares of a tenth and of a quarter.
PRIOR = 5.0
#: A word; or the end of a sentence: its mark before white space, a blank line, or a line that starts with a mark.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=\s|$)|\n(?=\s*\n|[ \t]*[-*#>|•]|[ \t]*\w+:[ \t])")


class _Numbers(dict):
    def __init__(self) -> None:
        self.hashes = Hashes()

    def __missing__(self, token: str) -> int:
        n = -1 if not token[0].isalpha() else self.hashes[token] % BUCKETS
        if len(self) < 1_000_000:
            self[token] = n
        return n


def tokens(documents: DataFrame) -> DataFrame:
    """doc_id, ids: little-endian int32 word numbers with -1 at sentence ends. Null and blank texts have no row."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _Numbers().__getitem__
        for df in batches:
            ids, docs = [], []
            for d, t in zip(df["doc_id"].tolist(), df["text"], strict=True):
                if t and (found := _TOKEN.findall(t.lower())):
                    ids.append(np.fromiter(map(number, found), np.int32, len(found)).tobytes())
                    docs.append(d)
            yield pd.DataFrame({"doc_id": docs, "ids": ids})

    return documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInPandas(make, "doc_id bigint, ids binary")


@dataclass
class Flat:
    """Sentences of a batch: word numbers, the sentence of each, and the document (by row) of each sentence."""

    word: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(blobs: list[bytes]) -> Flat:
        x = np.frombuffer(b"".join(blobs), np.int32)
        doc = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
        if not len(x):
            return Flat(x, x.astype(np.int64), x.astype(np.int64))
        new = np.r_[True, (x[:-1] < 0) | (doc[1:] != doc[:-1])]
        word = x >= 0
        # Numbers of the sentences that have words, without gaps.
        _, sentence = np.unique(np.cumsum(new)[word], return_inverse=True)
        first = np.r_[True, sentence[1:] != sentence[:-1]] if len(sentence) else np.zeros(0, bool)
        return Flat(x[word], sentence, doc[word][first])


@dataclass
class Model:
    """Weights of the words that say something, by word number (sorted)."""

    words: np.ndarray
    weights: np.ndarray

    def scores(self, f: Flat, n_subjects: int) -> np.ndarray:
        """sentences x subjects: summed weights."""
        out = np.zeros((len(f.doc), n_subjects))
        if not len(self.words) or not len(f.word):
            return out
        at = np.searchsorted(self.words, f.word)
        at[at == len(self.words)] = 0
        known = self.words[at] == f.word
        w, s = self.weights[at[known]], f.sentence[known]
        for k in range(n_subjects):
            out[:, k] = np.bincount(s, w[:, k], len(f.doc))
        return out

    @staticmethod
    def fit(counts: DataFrame, n_subjects: int) -> Model:
        """From (word, n, b, c0, c1, ...): n is how often a word was seen (by document or by sentence), c its
        expected occurrences by subject, b those in sentences of none. A word that is as common in sentences
        of no subject says nothing, even if of all subjects only one uses it. Words are gated by the JVM;
        only those that pass come to the driver."""
        names = [f"c{k}" for k in range(n_subjects)]
        total = counts.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in ["b", *names]]).first()
        size, none, by = max(1, total[0]), float(total[1]), np.array(total[2:], float)
        rate = [F.col(c) / float(max(b, 1e-9)) for c, b in zip(names, by, strict=True)]
        share = F.greatest(*rate) / sum(rate[1:], rate[0]) if n_subjects > 1 else F.lit(1.0)
        own = sum((F.col(c) for c in names[1:]), F.col(names[0]))
        rows = (
            counts.filter(own > 0)
            .filter((share * own / (own + F.col("b")) * F.col("n") + 0.5) / (F.col("n") + SHRINK) >= GATE)
            .select("word", "b", *names)
            .toPandas()
            .sort_values("word")
        )
        c = rows[names].to_numpy(float)
        a = SMOOTH  # all rates below are of complements
        every = rows[["b"]].to_numpy(float) + c.sum(1, keepdims=True)
        rest = (every - c + a) / (by.sum() + none - by + a * size)
        none_rest = (c.sum(1, keepdims=True) + a) / (by.sum() + a * size)
        return Model(rows["word"].to_numpy(np.int32), SHARP * np.log(none_rest / rest))


def _summed(df: DataFrame, n_subjects: int, name: str) -> DataFrame:
    names = ["n", "b", *(f"c{k}" for k in range(n_subjects))]
    return written(df.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]), name)


def _counts_ddl(n: int) -> str:
    return "word int, n double, b double, " + ", ".join(f"c{k} double" for k in range(n))


def _labelled_counts(feats: DataFrame, n: int) -> DataFrame:
    """Word counts of labelled documents; a document counts for each of its labels in equal parts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            f = Flat.of(df["ids"].tolist())
            words, inv = np.unique(f.word, return_inverse=True)
            doc = f.doc[f.sentence] if len(f.word) else f.word
            of = np.zeros((len(df), n))
            for r, ls in enumerate(df["labels"]):
                of[r, ls] = 1 / len(ls)
            c = {f"c{k}": np.bincount(inv, of[doc, k], len(words)) for k in range(n)}
            pairs = np.unique(inv.astype(np.int64) * max(1, len(df)) + doc)
            seen = np.bincount(pairs // max(1, len(df)), minlength=len(words))
            yield pd.DataFrame({"word": words, "n": seen.astype(float), "b": 0.0, **c})

    return _summed(feats.select("ids", "labels").mapInPandas(count, _counts_ddl(n)), n, "labelled")


def _expected_counts(feats: DataFrame, shared, n: int) -> DataFrame:
    """E step and the sums of the M step: every sentence counts for the subjects by its posterior."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            f = Flat.of(df["ids"].tolist())
            s = shared.value.scores(f, n)
            top = np.maximum(s.max(axis=1, initial=NONE), NONE)[:, None]
            e = np.exp(s - top)
            e /= e.sum(axis=1, keepdims=True) + np.exp(NONE - top)
            words, inv = np.unique(f.word, return_inverse=True)
            c = {f"c{k}": np.bincount(inv, e[f.sentence, k], len(words)) for k in range(n)}
            seen = np.bincount(inv, minlength=len(words)).astype(float)
            none = np.bincount(inv, np.maximum(0.0, 1 - e.sum(axis=1))[f.sentence], len(words))
            yield pd.DataFrame({"word": words, "n": seen, "b": none, **c})

    return _summed(feats.select("ids").mapInPandas(count, _counts_ddl(n)), n, "expected")


def _shares(feats: DataFrame, shared, n: int, extra: str = "") -> DataFrame:
    """doc_id, k, share of sentences, for shares above 0."""

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            f = Flat.of(df["ids"].tolist())
            s = shared.value.scores(f, n)
            k = s.argmax(axis=1) if len(s) else np.zeros(0, int)
            ok = s.max(axis=1, initial=0) > NONE
            size = np.bincount(f.doc, minlength=len(df))
            part = np.bincount(f.doc[ok] * n + k[ok], minlength=len(df) * n).reshape(len(df), n) / np.maximum(size, 1)[:, None]
            r, c = np.nonzero(part)
            yield pd.DataFrame({"doc_id": df["doc_id"].to_numpy()[r], "k": c, "share": part[r, c]})

    return feats.select("doc_id", "ids").mapInPandas(share, "doc_id bigint, k int, share double")


def _log_odds(x: np.ndarray) -> np.ndarray:
    return np.log((x + 0.01) / (1.01 - x))


def _calibrated(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the posterior that a document treats a subject, over the log odds of its share.

    Labels are noisy, so a label is a sign only: given at one rate to documents that treat the subject, at another to
    those that don't. Expectation-maximization over bins of shares finds both rates and the logistic curve
    (Newton's method). Bins: shares, and how many cases have the label and have it not; and, as the problem is
    stated, ``PRIOR`` cases of a tenth that don't treat the subject and of a quarter that do.
    """
    if not len(x):
        x, yes, no = np.zeros(1), np.zeros(1), np.zeros(1)
    t, own = _log_odds(np.r_[x, 0.1, 0.25]), np.r_[yes + no, PRIOR, PRIOR]
    a, b, hi, lo = -float(t[-2:].mean()) * 4, 4.0, 0.9, 0.01
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a + b * t, -30, 30)))
        q = p[: len(x)]
        with_label, without = q * hi / np.maximum(q * hi + (1 - q) * lo, 1e-300), q * (1 - hi) / np.maximum(q * (1 - hi) + (1 - q) * (1 - lo), 1e-300)
        z = np.r_[yes * with_label + no * without, 0.0, PRIOR]
        hi = float(np.clip((yes * with_label).sum() / max(z[: len(x)].sum(), 1e-9), 0.5, 0.999))
        lo = float(np.clip((yes * (1 - with_label)).sum() / max((yes + no).sum() - z[: len(x)].sum(), 1e-9), 1e-4, 0.3))
        for _ in range(10):
            p = 1 / (1 + np.exp(-np.clip(a + b * t, -30, 30)))
            w, g = own * p * (1 - p), z - own * p
            h = np.array([[w.sum() + 1e-3, (w * t).sum()], [(w * t).sum(), (w * t * t).sum() + 1e-3]])
            step = np.clip(np.linalg.solve(h, [g.sum(), (g * t).sum()]), -2, 2)
            a, b = a + float(step[0]), min(max(b + float(step[1]), 0.5), 20.0)
            if abs(step).max() < 1e-6:
                break
    return a, b


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, subject, share (of the document's sentences that treat it), posterior (calibrated), for shares above 0.

    documents: doc_id, text; subjects: subject; labels: doc_id, subject (noisy ones are fine; unknown subjects,
    nulls and repeated rows don't count). Null ids and null or blank texts have no rows. Without labels or subjects
    the result is empty; a subject without any label is never assigned. Repeated doc_ids come out once
    per row; other columns are ignored. Texts are read whole and tokenized once; all statistics but the
    first model's are of all documents.
    """
    spark = documents.sparkSession
    names = sorted(r.subject for r in subjects.filter("subject is not null").select("subject").distinct().collect())
    n = len(names)
    schema = "doc_id bigint, subject string, share double, posterior double"
    if not n:
        return spark.createDataFrame([], schema)
    feats = written(tokens(documents), "tokens")
    number = spark.createDataFrame(list(enumerate(names)), "k int, subject string")
    lab = (
        labels.select("doc_id", "subject").filter("doc_id is not null").join(F.broadcast(number), "subject")
        .groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("labels"))
        .orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    )
    known = written(feats.join(lab, "doc_id"), "known")
    model = Model.fit(_labelled_counts(known, n), n)
    for _ in range(rounds):
        model = Model.fit(_expected_counts(feats, spark.sparkContext.broadcast(model), n), n)
    shared = spark.sparkContext.broadcast(model)
    has = known.select("doc_id", F.explode("labels").alias("k")).withColumn("label", F.lit(1))
    bins = (
        _shares(known, shared, n).join(has, ["doc_id", "k"], "full")
        .groupBy(F.round(F.coalesce("share", F.lit(0.0)), 2).alias("x"))
        .agg(F.sum(F.coalesce("label", F.lit(0))).alias("yes"), F.count("*").alias("n"))
        .collect()  # 101 rows at most
    )
    zero = known.count() * n - sum(r.n for r in bins)
    x = np.array([r.x for r in bins] + [0.0])
    yes = np.array([r.yes for r in bins] + [0], float)
    a, b = _calibrated(x, yes, np.array([r.n for r in bins] + [max(0, zero)], float) - yes)
    odds = F.log((F.col("share") + 0.01) / (1.01 - F.col("share")))
    posterior = F.round(F.greatest(F.least(1 / (1 + F.exp(-(odds * b + a))), F.lit(1 - 1e-6)), F.lit(1e-6)), 6)  # never certain
    subject = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("k") + 1)
    return _shares(feats, shared, n).select("doc_id", subject.alias("subject"), "share", posterior.alias("posterior"))


def composition(found: DataFrame) -> DataFrame:
    """Per subject: documents that treat it, their expected number by the posteriors, mean share."""
    return found.filter(F.col("posterior") >= LEAST_POSTERIOR).groupBy("subject").agg(
        F.count("*").alias("n_documents"), F.round(F.sum("posterior"), 3).alias("expected"), F.round(F.avg("share"), 4).alias("mean_share")
    )
