"""Narration tokens, n-grams and name similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_REFERENCE = 6
MAX_PARTS = 3


# Fixed value: what a reference's parts are made of.
_PART = "[A-Za-z0-9]+"


def narration_tokens(text: Column) -> Column:
    """Distinct upper-case tokens of six characters or more.

    A run of letters and digits joined by hyphens gives each contiguous part of one to
    three members, so that a reference next to other text is still found whole.
    """
    whole = F.coalesce(text, F.lit(""))
    # a look-ahead takes nothing, so parts may overlap
    found = [F.regexp_extract_all(whole, F.lit(f"(?<![A-Za-z0-9])(?=({'-'.join([_PART] * n)}))"), F.lit(1)) for n in range(1, MAX_PARTS + 1)]
    upper = F.split(F.upper(F.array_join(F.concat(*found), " ")), " ")
    return F.array_distinct(F.filter(upper, lambda t: F.length(t) >= MIN_REFERENCE))


def references(narration: Column, *structured: Column) -> Column:
    """A credit's reference values: its own fields and the tokens of its narration."""
    own = F.filter(F.array(*[F.upper(c) for c in structured]) if structured else F.expr("cast(array() as array<string>)"), lambda t: t.isNotNull() & (F.length(t) >= MIN_REFERENCE))
    return F.array_distinct(F.concat(own, narration_tokens(narration)))


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams, repeats included, of the lower-cased text with single blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return F.concat(*[_pieces(F.length(t), n, lambda i, n=n: F.substring(t, i, F.lit(n))) for n in range(low, high + 1)])


def _pieces(size: Column, n: int, piece) -> Column:
    """``piece(i)`` for each of the places 1.. at which n members fit."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: piece(i))).otherwise(F.expr("cast(array() as array<string>)"))


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    """Word n-grams, repeats included; a word has two word characters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.concat(*[_pieces(F.size(words), n, lambda i, n=n: F.array_join(F.slice(words, i, n), " ")) for n in range(low, high + 1)])


#: Pairs of names that are compared together.
_TOGETHER = 8192


def jaro_winkler_pairs(left: list[str], right: list[str], weight: float = 0.1) -> np.ndarray:
    """Jaro-Winkler similarity of each pair of names, 0 if either is empty; all pairs at once, a letter at a time."""
    a, b = (np.array(x, dtype=f"U{max(1, *map(len, x))}").reshape(-1, 1).view(np.uint32) for x in (left, right))
    la, lb = (np.array([len(s) for s in x]) for x in (left, right))
    at_a, at_b = np.arange(a.shape[1]), np.arange(b.shape[1])
    reach = np.maximum(la, lb) // 2 - 1
    ours, taken = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    inside = at_b[None, :] < lb[:, None]
    for i in range(a.shape[1]):
        free = (b == a[:, i : i + 1]) & inside & ~taken & (np.abs(at_b[None, :] - i) <= reach[:, None]) & (i < la)[:, None]
        hit = free.any(axis=1)
        rows = np.flatnonzero(hit)
        taken[rows, free[rows].argmax(axis=1)] = True
        ours[:, i] = hit
    m = ours.sum(axis=1)
    width = int(m.max(initial=0))
    # the letters that met, in their order on each side
    first, second = (np.take_along_axis(x, np.argsort(~mask, axis=1, kind="stable"), axis=1)[:, :width] for x, mask in ((a, ours), (b, taken)))
    moved = ((first != second) & (np.arange(width)[None, :] < m[:, None])).sum(axis=1) // 2
    n = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / n) / 3, 0.0)
    head = min(4, a.shape[1], b.shape[1])
    same = (a[:, :head] == b[:, :head]) & (at_a[None, :head] < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    out = np.where(jaro > 0.7, jaro + prefix * weight * (1 - jaro), jaro)  # only fair matches profit from a common prefix
    equal = np.array([x == y for x, y in zip(left, right, strict=True)], dtype=bool)
    return np.where((la == 0) | (lb == 0), 0.0, np.where(equal, 1.0, out))


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; 0 if either name is empty or null.  Each distinct pair of a batch is computed once."""
    pairs = pd.DataFrame({"a": a.fillna(""), "b": b.fillna("")})
    code, known = pairs.groupby(["a", "b"], sort=False).ngroup().to_numpy(), pairs.drop_duplicates()
    known = known.iloc[(order := np.argsort(known["a"].str.len().to_numpy() + known["b"].str.len().to_numpy(), kind="stable"))]
    found = np.zeros(len(known))
    for i in range(0, len(known), _TOGETHER):
        part = known.iloc[i : i + _TOGETHER]
        found[order[i : i + _TOGETHER]] = jaro_winkler_pairs(part["a"].tolist(), part["b"].tolist())
    return pd.Series(found[code] if len(code) else found, dtype="float64")


def squeeze(text: Column, limit: int = 400) -> Column:
    """Text in one line, cut to ``limit`` characters with dots; for prompts."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)
