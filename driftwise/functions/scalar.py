"""Scalar Column helpers (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_lookup(mapping: Mapping, key: Column) -> Column:
    """Equi lookup into a literal map (broadcast by construction: it lives in the plan)."""
    if not mapping:
        return F.lit(None)
    items = []
    for k, v in mapping.items():
        items.extend([F.lit(k), F.lit(v)])
    return F.try_element_at(F.create_map(*items), key)


def pround(v: float | None, digits: int = 6) -> float | None:
    """Driver-side twin of ``rnd`` for the few report values computed on the driver."""
    if v is None or math.isnan(v) or math.isinf(v):
        return v
    scale = float(10**digits)
    return math.copysign(math.floor(abs(v) * scale + 0.5), v) / scale


def to_double(c: Column) -> Column:
    """numeric parse with coerce; NaN becomes NULL (NaN = missing everywhere)."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """Zero-division → 0 (sklearn ``zero_division=0``)."""
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def clamp_ratio(a: Column, b: Column, floor: float = 0.001) -> Column:
    """x / clamp_min(y, floor)."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(float(floor)))


def rnd(c: Column, digits: int = 6) -> Column:
    """Round a DOUBLE to ``digits`` decimals as round-half-away-from-zero on x·10^d.

    Spark's ``round`` rounds the *decimal string* of a double half-up, SQL
    engines that scale in binary disagree with it exactly on ties such as
    1032.2150625; scaling in binary on both sides keeps reports identical.
    """
    x = c.cast("double")
    scale = F.lit(float(10**digits))
    r = F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale
    return F.when(x.isNull() | F.isnan(x) | ~(F.abs(x) < F.lit(float("inf"))), x).otherwise(r)


def month_number(c: Column) -> Column:
    """month name / abbreviation → 1..12, else the parsed number, else 0 (double)."""
    s = F.lower(F.trim(c.cast("string")))
    named = map_lookup(MONTHS, s).cast("double")
    numeric = to_double(F.trim(c.cast("string")))
    return F.coalesce(named, numeric, F.lit(0.0))


# Month spellings accepted by the month parser (full names, 3-letter forms).
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


def month_sin(m: Column) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * m.cast("double") / F.lit(12.0))


def month_cos(m: Column) -> Column:
    return F.cos(F.lit(2.0 * math.pi) * m.cast("double") / F.lit(12.0))


def cosine_similarity(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """dot / (|a|·|b| + eps) over array<float> columns, vectorised in the JVM."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return dot / (na * nb + F.lit(eps))


def keyword_fraction(text: Column, keywords: Sequence[str]) -> Column:
    """share of keywords found as substrings of the (lower-cased) text."""
    kw = F.array(*[F.lit(k.lower()) for k in keywords])
    low = F.lower(text)
    hits = F.aggregate(kw, F.lit(0), lambda acc, k: acc + F.when(F.instr(low, k) > 0, 1).otherwise(0))
    return hits.cast("double") / F.lit(float(len(keywords)))


def slug(c: Column, width: int = 24, default: str = "kb") -> Column:
    """non-alphanumerics → '-', trimmed of '-', first ``width`` chars, default when empty."""
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    s = F.substring(s, 1, width)
    return F.when(F.length(s) == 0, F.lit(default)).otherwise(s)
