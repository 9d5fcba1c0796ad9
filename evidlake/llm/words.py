"""Words of a text and their hashes, as the operators here share them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

#: A word is a longest run of letters and digits; case is ignored.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hashes(dict):
    """Word -> 32-bit hash, kept per task; emptied when it grows beyond a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (the published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash per run of n words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + hashes[k : len(hashes) - n + 1 + k] + np.uint64(k + 1))
    return out


def sorted_groups(batches: Iterator[pd.DataFrame], key: list[str], least: int = 2) -> Iterator[pd.DataFrame]:
    """Chunks of whole groups from batches sorted by key; groups of fewer than ``least`` rows are left out.

    The parts of a group that goes on over several batches are joined once, at its end.
    """
    rest: list[pd.DataFrame] = []

    def cut(df: pd.DataFrame) -> np.ndarray:
        k = df[key].to_numpy()
        return np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(df)]

    def large(df: pd.DataFrame) -> pd.DataFrame:
        at = cut(df)
        return df[np.repeat(np.diff(at) >= least, np.diff(at))]

    for df in batches:
        if not len(df):
            continue
        at = cut(df)
        if rest and (rest[-1][key].iloc[-1] == df[key].iloc[0]).all():
            if len(at) == 2:
                rest.append(df)
                continue
            rest.append(df.iloc[: at[1]])
            df, at = df.iloc[at[1] :], at[1:] - at[1]
        if rest:
            whole = pd.concat(rest, ignore_index=True)
            if len(whole) >= least:
                yield whole
        if at[-2] and len(out := large(df.iloc[: at[-2]])):
            yield out
        rest = [df.iloc[at[-2] :]]
    if rest:
        whole = pd.concat(rest, ignore_index=True)
        if len(whole) >= least:
            yield whole


def each_group(df: pd.DataFrame, key: list[str]) -> Iterator[tuple[int, int]]:
    """Start and end of each group of a chunk that is sorted by key."""
    k = df[key].to_numpy()
    at = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(df)]
    yield from zip(at[:-1], at[1:], strict=True)
