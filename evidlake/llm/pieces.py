"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Boundaries from the strongest to the weakest; a piece ends after a match.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"\n(?=[ \t]*#{1,6}[ \t])|\n(?=[ \t]*(?:-{3,}|={3,}|\*{3,})[ \t]*(?:\r?\n|$))",  # section
        r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+| ",  # paragraph
        r"\r\n|\n|\r(?!\n)| |(?<=[.!?…])[\"'”’)\]]*[ \t]+|(?<=[。！？])",  # line, sentence
        r"\s+|(?<=[,;:、，；])",  # word
    )
)
LIMIT, OVERLAP = 1800, 150


def _widths(text: str) -> np.ndarray:
    """Byte offset of each character in UTF-8, and the end (lone surrogates count three)."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    w = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
    return np.r_[0, np.cumsum(w)]


def _last_end(level: re.Pattern, text: str, least: int, most: int) -> int:
    """End of the last match that ends in least..most, 0 without one. Looks at that window only."""
    end = 0
    for m in level.finditer(text, max(0, least - 1), most + 8):
        if m.end() > most:
            break
        if m.end() >= least:
            end = m.end()
    return end


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Character spans of the pieces of a text, each of at most ``limit`` bytes of UTF-8.

    Spans cover the text without gaps; each begins about ``overlap`` bytes before the last one's end, at a
    word's start if one lies near. A piece is packed with the parts of the strongest separator level
    (section, paragraph, sentence, word) that fill at least half of it; where no part of a level ends
    there, its next part is oversized and the next level splits it, down to single characters, which are
    never cut. A text within the limit is one piece; an empty one has one empty piece.
    """
    if not 0 <= overlap * 2 < limit or limit < 8:
        raise ValueError("the limit must be 8 bytes or more, and more than twice the overlap")
    if len(text) * 4 <= limit:
        return [(0, len(text))]
    at = range(len(text) + 1) if text.isascii() else _widths(text).tolist()
    if at[-1] <= limit:
        return [(0, len(text))]
    half = (limit - overlap) // 2
    out: list[tuple[int, int]] = []
    start = begin = 0  # where the piece's new text starts; where the piece with its overlap begins
    while True:
        far = bisect_right(at, at[begin] + limit) - 1
        if far >= len(text):
            out.append((begin, len(text)))
            return out
        least = max(start + 1, bisect_left(at, at[start] + half))
        end = next((e for level in LEVELS if (e := _last_end(level, text, least, far))), 0)
        end = end or _last_end(LEVELS[-1], text, start + 1, far) or far
        out.append((begin, end))
        start = end
        begin = max(bisect_left(at, at[end] - overlap), begin + 1)
        m = LEVELS[-1].search(text, begin, end)
        if m and m.end() < end and at[m.end()] - at[begin] <= overlap // 3:
            begin = m.end()


def split_texts(df: DataFrame, key: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows -> key columns, piece_no (from 1), start_pos and end_pos (characters from 1, end included), n_bytes, piece.

    A null text has no pieces. Repeated rows give repeated pieces; distinct() drops them. One text is
    split in time linear in its length, whatever its layout; texts don't meet, so nothing is shuffled.
    Other columns of df are left out.
    """
    ddl = ", ".join(f"`{c}` {t}" for c, t in df.select(*key).dtypes)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for r in pdf.itertuples(index=False, name=None):
                t = r[-1]
                if t is None:
                    continue
                for k, (a, b) in enumerate(split_spans(t, limit, overlap), 1):
                    piece = t[a:b]
                    rows.append((*r[:-1], k, a + 1, b, len(piece.encode("utf-8", "surrogatepass")), piece))
            yield pd.DataFrame(rows, columns=[*key, "piece_no", "start_pos", "end_pos", "n_bytes", "piece"])

    return df.select(*key, text).mapInPandas(make, f"{ddl}, piece_no int, start_pos bigint, end_pos bigint, n_bytes bigint, piece string")
