"""Small SQL text builders for oracle queries (UNION ALL long forms over fixed column lists)."""

from __future__ import annotations

from collections.abc import Sequence


def long_union(cols: Sequence[str], source: str = "bookings", side: str | None = "period", cast: str = "DOUBLE") -> str:
    """SELECT [side,] 'c' AS column_name, CAST(c AS <cast>) AS value FROM source WHERE c IS NOT NULL UNION ALL ..."""
    parts = []
    for c in cols:
        side_sel = f"{side} AS side, " if side else ""
        cond = f"{c} IS NOT NULL" + (f" AND NOT isnan(CAST({c} AS DOUBLE))" if cast == "DOUBLE" else "")
        parts.append(f"SELECT {side_sel}'{c}' AS column_name, CAST({c} AS {cast}) AS value FROM {source} WHERE {cond}")
    return "\n  UNION ALL ".join(parts)


def bin_expr(value: str = "value", lo: str = "lo", hi: str = "hi", n_bins: int = 10) -> str:
    """Equal-width bin index with exact edge correction (same double arithmetic as the Spark side)."""
    step = f"(({hi} - {lo}) / CAST({n_bins} AS DOUBLE))"
    k0 = f"CAST(least(greatest(floor(({value} - {lo}) / {step}), 0), {n_bins - 1}) AS INTEGER)"
    return (
        f"CASE WHEN {value} < {lo} + CAST({k0} AS DOUBLE) * {step} THEN {k0} - 1 "
        f"WHEN {k0} < {n_bins - 1} AND {value} >= {lo} + CAST({k0} + 1 AS DOUBLE) * {step} THEN {k0} + 1 "
        f"ELSE {k0} END"
    )


def binned_counts_ctes(long_sql: str, n_bins: int = 10) -> str:
    """CTEs long/rng/b/cnt/fullc: zero-filled (column_name, bin, n_ref, n_cur, tot_ref, tot_cur, constant)."""
    return f"""
long AS ({long_sql}),
rng AS (SELECT column_name, min(value) AS lo, max(value) AS hi,
               count_if(side = 'ref') AS tot_ref, count_if(side = 'cur') AS tot_cur FROM long GROUP BY column_name),
b AS (SELECT l.column_name, l.side, {bin_expr('l.value', 'r.lo', 'r.hi', n_bins)} AS bin
      FROM long l JOIN rng r ON l.column_name = r.column_name WHERE r.hi > r.lo),
cnt AS (SELECT column_name, bin, count_if(side = 'ref') AS n_ref, count_if(side = 'cur') AS n_cur FROM b GROUP BY ALL),
grid AS (SELECT column_name, tot_ref, tot_cur, hi <= lo AS constant, unnest(range(0, {n_bins})) AS bin FROM rng),
fullc AS (SELECT g.column_name, g.bin, coalesce(c.n_ref, 0) AS n_ref, coalesce(c.n_cur, 0) AS n_cur,
                g.tot_ref, g.tot_cur, g.constant
         FROM grid g LEFT JOIN cnt c ON g.column_name = c.column_name AND g.bin = c.bin)"""


def divergence_select(metric: str = "psi", n_bins: int = 10) -> str:
    e = f"((n_ref + CAST(1e-8 AS DOUBLE)) / (tot_ref + CAST(1e-8 AS DOUBLE) * {n_bins}))"
    a = f"((n_cur + CAST(1e-8 AS DOUBLE)) / (tot_cur + CAST(1e-8 AS DOUBLE) * {n_bins}))"
    if metric == "psi":
        term = f"({a} - {e}) * ln({a} / {e})"
        score = "s"
    else:
        m = f"(0.5 * ({e} + {a}))"
        term = f"{e} * log2({e} / {m}) + {a} * log2({a} / {m})"
        score = "least(greatest(0.5 * s, 0.0), 1.0)"
    return f"""
div AS (SELECT column_name, sum({term}) AS s, any_value(tot_ref) AS n_ref, any_value(tot_cur) AS n_cur,
               bool_or(constant) AS constant FROM fullc GROUP BY column_name),
scores AS (SELECT column_name, CASE WHEN constant THEN 0.0 ELSE {score} END AS score, n_ref, n_cur FROM div)"""
