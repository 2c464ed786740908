"""Vectorised scalar helpers that built-in functions cannot express: word stems, multisets and common subsequences."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

# Suffix tables of the published stemming algorithm (Porter, 1980).
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c and v per letter; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(100_000)
def porter_stem(w: str) -> str:
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            stem = w[: -len(end)]
            if w.endswith(end) and "v" in _shape(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + new
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one integer."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = row = (1 << len(b)) - 1
    for x in a:
        here = row & places.get(x, 0)
        row = (row + here | row - here) & every
    return len(b) - row.bit_count()


def _counted(column: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word) pairs of a list column as one number each, sorted, and how often each stands."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.unique(np.repeat(np.arange(len(column), dtype=np.int64), sizes) << 32 | codes, return_counts=True)


def overlap():
    """Arrow UDF: size of the intersection of two word arrays as multisets (0 if one is null). A batch is two sorts of word numbers."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        flat = pa.concat_arrays([a.flatten(), b.flatten()])
        codes = pc.fill_null(flat.dictionary_encode(null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(a.flatten())
        (x, i), (y, j) = _counted(a, codes[:n]), _counted(b, codes[n:])
        both, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        return pa.array(np.bincount(both >> 32, np.minimum(i[at], j[to]), len(a)).astype(np.int32))

    return run


def stems():
    """Arrow UDF: array of words to array of stems; each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(words: pa.Array) -> pa.Array:
        flat = words.flatten().dictionary_encode()
        known = pa.array([porter_stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        offsets = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]), pa.int32())
        return pa.ListArray.from_arrays(offsets, known.take(flat.indices), mask=words.is_null())

    return run


def lcs():
    """Pandas UDF: length of the longest common subsequence of two word arrays."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    return run
