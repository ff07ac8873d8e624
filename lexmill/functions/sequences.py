"""Longest common subsequences of word lists, a machine word's worth of cells at a time, and the score that is built on them."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .english import stem

#: Different words whose stems a task remembers.
REMEMBERED = 1 << 18
#: Words of so many letters or fewer are left as they are.
WHOLE = 3


def longest_common(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence.

    A row of the usual table rises by 0 or 1 from cell to cell, so it is kept as one number with a bit for each place of `b`, 0 where
    it rises. A word of `a` turns the row into the next one by an addition, whose carries find the next place of that word in each
    run between rises: len(a) operations on len(b) bits. What stands alike at both ends is taken off first.
    """
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    places: dict[str, int] = {}
    for j, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for word in a:
        if own := places.get(word):
            met = row & own
            row = ((row + met) | (row - met)) & whole
    return lo + hi + len(b) - row.bit_count()


@functools.lru_cache(maxsize=REMEMBERED)
def normal(word: str) -> str:
    return stem(word) if len(word) > WHOLE else word


def words_of(text: str | None) -> list[str]:
    """Stems of the lower-cased runs of ASCII letters and digits; a task stems each different word once."""
    return [normal(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of stemmed words; 0 where a text has none."""
    out = []
    for r, h in zip(reference, hypothesis):
        a, b = words_of(r), words_of(h)
        n = longest_common(a, b)
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out)
