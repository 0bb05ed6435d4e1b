"""Text folding and fuzzy scores as vectorised functions.

The scores follow the public description of the indel similarity: 200 * LCS / (|a| + |b|) for two strings, the token-set variant over
the common and the remaining words, and a weighted one that takes the best of plain, sorted and token-set scores, or, where one
string is half as long again as the other, of the plain score and the best place of the shorter one in the longer one.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: str | None) -> str | None:
    """NFKD, ASCII only, single spaces, lower case."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"\s+", " ", plain).strip().lower()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows of arbitrary length; a common start and end belong to it whole."""
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if head + tail == n:
        return n
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return head + tail + len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = (" ".join(sorted(z)) for z in (x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = (f"{both} {z}".strip() for z in (only_x, only_y))
    scores = [ratio(with_x, with_y)]
    if both:
        scores += [ratio(both, with_x), ratio(both, with_y)]
    return max(scores)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any stretch of the longer one of its length, or less at either end."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    return max(ratio(a, b[max(i, 0) : i + len(a)]) for i in range(1 - len(a), len(b)))


def partial_token_ratio(a: str, b: str) -> float:
    """100 for a common word, else the partial ratio of the sorted words."""
    x, y = a.split(), b.split()
    return 100.0 if set(x) & set(y) else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer >= 1.5:
        scale = 0.9 if longer <= 8 else 0.6
        return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))
    return max(ratio(a, b), 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))


def _two(f):
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return apply


def folded(c: Column) -> Column:
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(fold)

    return apply(c)


def token_set(a: Column, b: Column) -> Column:
    return _two(token_set_ratio)(a, b)


def weighted(a: Column, b: Column, *, once: bool = False) -> Column:
    """once: a filter on the score is not moved before it, which would work it out twice."""
    f = _two(weighted_ratio)
    return (f.asNondeterministic() if once else f)(a, b)
