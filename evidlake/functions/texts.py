"""Text functions of entries, transcripts and excerpts, as JVM expressions; the chunker runs in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a secret, in the order of replacement.
SECRETS = (
    r"sk-[A-Za-z0-9]{20,}",
    r"ghp_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"xoxb-[0-9]+-[A-Za-z0-9]+",
    r"xoxp-[0-9]+-[A-Za-z0-9\-]+",
    r"AKIA[A-Z0-9]{16}",
    r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----",
    r"(?m)^[A-Z][A-Z0-9_]{2,}=(?:[A-Za-z0-9+/]{32,}={0,2}|[A-Za-z0-9]{40,})",
)
REDACTED = "<REDACTED>"
# The envelope of untrusted excerpts, and marks of tool calls in transcripts.
OPEN, CLOSE = "<<UNTRUSTED_EXCERPT>>", "<<END>>"
DIGEST_MARKS = ("Tool:", "<tool_use>", "fn_call:", "Bash(", "Read(", "Write(", "Edit(")
TELEMETRY_MARKS = (*DIGEST_MARKS, '"type":"tool_use"', '"type": "tool_use"', '"tool_name"')


def redacted(text: Column) -> Column:
    for p in SECRETS:
        text = F.regexp_replace(text, p, REDACTED)
    return text


def neutralized(excerpt: Column) -> Column:
    return F.replace(excerpt, F.lit("<<"), F.lit("<​<"))


def wrapped(excerpt: Column) -> Column:
    return F.concat(F.lit(OPEN), neutralized(excerpt), F.lit(CLOSE))


def excerpt_problem(excerpt: Column) -> Column:
    """Why an excerpt is refused, or null: too_long (512 characters), envelope_marker, control_character."""
    return F.when(F.length(excerpt) > 512, "too_long").when(excerpt.contains(OPEN) | excerpt.contains(CLOSE), "envelope_marker").when(excerpt.rlike(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"), "control_character")


def tags_problem(tags: Column) -> Column:
    return F.when(F.exists(tags, lambda t: F.coalesce(F.length(t), F.lit(0)) == 0), "empty_tag").when(F.exists(tags, lambda t: F.octet_length(t) > 50), "tag_too_long")


def clamped(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def byte_prefix(text: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that does not cut a character."""
    whole = F.octet_length(text) <= n
    chars = F.aggregate(
        F.split(F.substring(text, 1, n), ""),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("b"), F.lit(True).alias("on")),
        lambda a, c: F.struct(
            F.when(a["on"] & (a["b"] + F.octet_length(c) <= n), F.concat(a["s"], c)).otherwise(a["s"]).alias("s"),
            F.when(a["on"] & (a["b"] + F.octet_length(c) <= n), a["b"] + F.octet_length(c)).otherwise(a["b"]).alias("b"),
            (a["on"] & (a["b"] + F.octet_length(c) <= n)).alias("on"),
        ),
        lambda a: a["s"],
    )
    return F.when(whole, text).otherwise(chars)


def paragraphs(text: Column) -> Column:
    """Trimmed groups of lines between blank ones."""
    parts = F.split(text, r"\n(?:[^\S\n]*\n)+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def merged(parts: Column, least: int) -> Column:
    """Parts of fewer than ``least`` bytes go before the next, with a blank line between."""
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.octet_length(last(a)) < least), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last(a), F.lit("\n\n"), x)))).otherwise(F.concat(a, F.array(x))),
    )


def sentences(text: Column) -> Column:
    """Parts that end in ``.``, ``!`` or ``?`` before a space or a newline, trimmed."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \n]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def turns(text: Column, most: int = 500) -> Column:
    """Transcript turns between blank or ``---`` lines."""
    marked = F.regexp_replace(text, r"(?m)^[^\S\n]*(?:---)?[^\S\n]*$", "\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.slice(F.filter(parts, lambda s: s != ""), 1, most)


def tool_lines(text: Column, marks: tuple[str, ...] = DIGEST_MARKS) -> Column:
    hit = lambda line: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(line, m))
    return F.filter(F.split(text, "\n"), hit)


def digest(session_id: Column, text: Column) -> Column:
    """struct(head, tail, tools, hash): first and last three turns (none twice) and tool-call lines."""
    t = turns(text)
    n = F.size(t)
    head = F.array_join(F.slice(t, 1, 3), "\n\n---\n\n")
    k = F.greatest(n - 3, F.least(n, F.lit(3)))
    tail = F.array_join(F.slice(t, k + 1, F.greatest(n - k, F.lit(0))), "\n\n---\n\n")
    tools = F.array_join(tool_lines(text), "\n")
    return F.struct(head.alias("head"), tail.alias("tail"), tools.alias("tools"), F.sha2(F.concat_ws("|", session_id, head, tail, tools), 256).alias("hash"))


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def first_paragraph(text: Column) -> Column:
    return F.split_part(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n\n"), F.lit(1))


def branch_tokens(branch: Column) -> Column:
    """Words of a branch name, lower case, without a leading ``word-ticket-``."""
    words = F.split(F.regexp_replace(branch, r"^[a-z]+-[a-z0-9]+-", ""), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.lower(w))


def self_sized(row: dict, field: str, render) -> int:
    """Fixed point: the token estimate of a rendered row that contains that estimate."""
    n = 0
    for _ in range(16):
        now = (len(render({**row, field: n}).encode()) + 3) // 4
        if now == n:
            return n
        n = now
    return n


_HEADING = re.compile(r"(?m)^(?=#{1,3} )")
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \n]+")


def chunked(text: str, limit: int = 1800, overlap: int = 150) -> list[str]:
    """Chunks of at most ``limit`` bytes: sections (h1 to h3), paragraphs, sentences, then a hard split whose
    pieces overlap; parts that fit together in the limit are joined again. Never cuts a character."""
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))

    def hard(s: str) -> list[str]:
        out, at = [], 0
        while at < len(s):
            end = min(len(s), at + limit)
            while size(s[at:end]) > limit:
                end -= max(1, (size(s[at:end]) - limit) // 4)
            end = max(end, at + 1)
            out.append(s[at:end])
            if end == len(s):
                break
            back = end
            while back > at + 1 and size(s[back:end]) < overlap:
                back -= 1
            at = back
        return out

    def split(s: str, level: int) -> list[str]:
        if size(s) <= limit:
            return [s]
        if level == 3:
            return hard(s)
        parts = [p.strip() for p in (_HEADING, _BLANK, _SENTENCE)[level].split(s)]
        glue, out = ("\n\n", "\n\n", " ")[level], []
        for p in (q for part in parts if part for q in split(part, level + 1)):
            if level and out and size(out[-1]) + size(glue) + size(p) <= limit:
                out[-1] += glue + p
            else:
                out.append(p)
        return out

    return [c for c in split(text.strip(), 0) if c]


def chunk_rows(df: DataFrame, key: str, text: str, limit: int = 1800, overlap: int = 150) -> DataFrame:
    """key, chunk_no, chunk; the first chunk replaces what is at its path, the rest are added."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, i == 1, c) for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) if t for i, c in enumerate(chunked(t, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "replace_path", "chunk"])

    return df.select(key, text).mapInPandas(make, f"`{key}` {kind}, chunk_no int, replace_path boolean, chunk string")


def deduplicated(parts: list[str], vectors: list[list[float]], cutoff: float = 0.85) -> list[str]:
    """Greedy: a part whose cosine to an earlier kept one is above the cutoff is dropped. At most 512 parts."""
    import numpy as np

    m = np.array(vectors[:512], float).reshape(min(len(parts), 512), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    keep: list[int] = []
    for i in range(len(m)):
        if not keep or (m[keep] @ m[i]).max() <= cutoff:
            keep.append(i)
    return [parts[i] for i in keep]
