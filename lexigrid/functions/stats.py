"""Corpus statistics as Column expressions, each beside a scalar twin for single values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def rate(n: Column, d: Column) -> Column:
    """Per 10,000; 0 where nothing was counted."""
    return F.when(d == 0, 0.0).otherwise(n / d * 10000)


def _cell(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)


def g2(a: Column, n1: Column, b: Column, n2: Column) -> Column:
    """Signed log-likelihood of the 2 x 2 table; positive where the first side has the larger share."""
    total, hits = n1 + n2, a + b
    rest = total - hits
    value = 2 * (_cell(a, n1 * hits / total) + _cell(b, n2 * hits / total) + _cell(n1 - a, n1 * rest / total) + _cell(n2 - b, n2 * rest / total))
    return F.when(a * n2 >= b * n1, value).otherwise(-value)


def log_ratio(a: Column, n1: Column, b: Column, n2: Column) -> Column:
    return F.log2(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n2 + 1)))


def log_ratio_margin(a: Column, n1: Column, b: Column, n2: Column, z: float = Z95) -> Column:
    """Half the width of the Wald interval of ``log_ratio``."""
    variance = 1 / (a + 0.5) - 1 / (n1 + 1) + 1 / (b + 0.5) - 1 / (n2 + 1)
    return z * F.sqrt(F.greatest(variance, F.lit(0.0))) / math.log(2)


def jsd_term(p: Column, q: Column) -> Column:
    """A type's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    return 0.5 * (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0))


def log_dice(both: Column, x: Column, y: Column) -> Column:
    return 14 + F.log2(2 * both / (x + y))


def pmi(both: Column, x: Column, y: Column, n: Column) -> Column:
    return F.log2(both * n / (x * y))


def t_score(both: Column, x: Column, y: Column, n: Column) -> Column:
    return (both - x * y / n) / F.sqrt(both)


def readability(characters: Column, words: Column, sentences: Column) -> Column:
    """Automated readability index."""
    return 4.71 * characters / words + 0.5 * words / sentences - 21.43


def coleman_liau(letters: Column, words: Column, sentences: Column) -> Column:
    return 0.0588 * (letters / words * 100) - 0.296 * (sentences / words * 100) - 15.8


def rate_contrast(hits_a: Column, tokens_a: Column, hits_b: Column, tokens_b: Column) -> Column:
    """(ra - rb) / (ra + rb), null without tokens on a side or without hits."""
    ra, rb = hits_a / F.nullif(tokens_a, F.lit(0)), hits_b / F.nullif(tokens_b, F.lit(0))
    return F.when((hits_a + hits_b) > 0, (ra - rb) / (ra + rb))


# ---- scalars ---------------------------------------------------------------------------------------------------------


def g2_of(a: float, n1: float, b: float, n2: float) -> float:
    if min(a, b) < 0 or a > n1 or b > n2 or n1 + n2 <= 0:
        raise ValueError("counts must lie between 0 and their totals")
    part = lambda o, e: o * math.log(o / e) if o else 0.0
    total, hits = n1 + n2, a + b
    value = 2 * (part(a, n1 * hits / total) + part(b, n2 * hits / total) + part(n1 - a, n1 * (total - hits) / total) + part(n2 - b, n2 * (total - hits) / total))
    return value if a * n2 >= b * n1 else -value


def log_ratio_of(a: float, n1: float, b: float, n2: float) -> float:
    return math.log2(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n2 + 1)))


def log_ratio_interval_of(a: float, n1: float, b: float, n2: float, z: float = Z95) -> tuple[float, float]:
    middle = log_ratio_of(a, n1, b, n2)
    margin = z * math.sqrt(max(0.0, 1 / (a + 0.5) - 1 / (n1 + 1) + 1 / (b + 0.5) - 1 / (n2 + 1))) / math.log(2)
    return middle - margin, middle + margin


def log_dice_of(both: float, x: float, y: float) -> float:
    return 14 + math.log2(2 * both / (x + y))


def pmi_of(both: float, x: float, y: float, n: float) -> float:
    return math.log2(both * n / (x * y))


def t_score_of(both: float, x: float, y: float, n: float) -> float:
    return (both - x * y / n) / math.sqrt(both)


def dp_of(counts: Sequence[float], sizes: Sequence[float]) -> float:
    """Gries' deviation of proportions."""
    if len(counts) < 2 or len(counts) != len(sizes):
        raise ValueError("two parts or more are needed")
    n, total = sum(counts), sum(sizes)
    return min(1.0, max(0.0, 0.5 * sum(abs(c / n - s / total) for c, s in zip(counts, sizes, strict=True)))) if n else 0.0


def dp_norm_of(counts: Sequence[float], sizes: Sequence[float]) -> float:
    return dp_of(counts, sizes) / (1 - min(sizes) / sum(sizes))


def jsd_of(p: Sequence[float], q: Sequence[float]) -> float:
    for side in (p, q):
        if abs(sum(side) - 1) > 1e-9:
            raise ValueError("shares must add up to 1")
    term = lambda x, m: x * math.log2(x / m) if x else 0.0
    return min(1.0, max(0.0, sum(0.5 * (term(a, (a + b) / 2) + term(b, (a + b) / 2)) for a, b in zip(p, q, strict=True))))


def rate_contrast_of(hits_a: float, tokens_a: float, hits_b: float, tokens_b: float) -> float | None:
    if tokens_a <= 0 or tokens_b <= 0 or hits_a + hits_b <= 0:
        return None
    ra, rb = hits_a / tokens_a, hits_b / tokens_b
    return (ra - rb) / (ra + rb)


def mattr_of(types: Sequence[object], window: int) -> float:
    """Mean type-token ratio over all windows; the plain ratio where the text is no longer than one."""
    n = len(types)
    if not n:
        return 0.0
    if n <= window:
        return len(set(types)) / n
    last: dict[object, int] = {}
    total = 0
    for i, t in enumerate(types):
        before = last.get(t, -1)
        total += max(0, min(i, n - window) - max(before + 1, i - window + 1, 0) + 1)
        last[t] = i
    return total / (window * (n - window + 1))


def mtld_of(types: Sequence[object], threshold: float = 0.72) -> float:
    """Mean length of stretches that keep the type-token ratio above ``threshold``, both ways."""

    def one(seq: Sequence[object]) -> float:
        factors, seen, n, ratio = 0.0, set(), 0, 1.0
        for t in seq:
            seen.add(t)
            n += 1
            ratio = len(seen) / n
            if ratio <= threshold:
                factors, seen, n, ratio = factors + 1, set(), 0, 1.0
        if n:
            factors += (1 - ratio) / (1 - threshold)
        return len(seq) / factors if factors else float(len(seq))

    return (one(types) + one(list(reversed(types)))) / 2 if types else 0.0


def readability_of(characters: int, words: int, sentences: int) -> float:
    if characters < words or sentences > words or sentences < 1:
        raise ValueError("a word has a character, a sentence a word")
    return 4.71 * characters / words + 0.5 * words / sentences - 21.43


def coleman_liau_of(letters: int, words: int, sentences: int) -> float:
    return 0.0588 * (letters / words * 100) - 0.296 * (sentences / words * 100) - 15.8
