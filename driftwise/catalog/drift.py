"""Named queries for drift between the reference and current booking periods (step 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.catalog.profiles import CATEGORY_COLS, CORR_TOP_K, PROFILE_COLS, corr_list_sql
from driftwise.catalog.sqlgen import bin_expr, binned_counts_ctes, divergence_select, long_union
from driftwise.functions.scalar import pround, rnd
from driftwise.operators import drift as dr
from driftwise.operators import profile as pf
from driftwise.sources.tables import bookings

DRIFT_COLS = PROFILE_COLS
THRESHOLD_OVERRIDES = {"lead_time": 0.15}
CRITICAL = ["adr"]


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = bookings(spark, sf_dir)
    return b.where(F.col("period") == "ref"), b.where(F.col("period") == "cur")


def _ref_stats(ref: DataFrame) -> DataFrame:
    return pf.numeric_profile(ref, DRIFT_COLS, digits=None, quantiles=False)


_CUR_REF = "ref AS (SELECT * FROM bookings WHERE period = 'ref'),\ncur AS (SELECT * FROM bookings WHERE period = 'cur')"


def _stats_union(cols, source, prefix):
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(CAST({c} AS DOUBLE)) AS {prefix}n, avg(CAST({c} AS DOUBLE)) AS {prefix}mean, "
        f"stddev_samp(CAST({c} AS DOUBLE)) AS {prefix}std, min(CAST({c} AS DOUBLE)) AS {prefix}min, "
        f"max(CAST({c} AS DOUBLE)) AS {prefix}max FROM {source}"
        for c in cols
    )


_STATS_CTES = f"""{_CUR_REF},
rs AS ({_stats_union(DRIFT_COLS, 'ref', 'r_')}),
cs AS ({_stats_union(DRIFT_COLS, 'cur', 'c_')}),
j AS (SELECT * FROM rs JOIN cs USING (column_name) WHERE r_n > 0)"""


@register(
    "distribution_check",
    with_bookings(
        """
SELECT column_name, "check" FROM (
  SELECT column_name, 'mean_drift' AS "check" FROM j WHERE c_n > 0 AND r_std > 0 AND abs(c_mean - r_mean) > 3.0 * r_std
  UNION ALL SELECT column_name, 'non_empty' FROM j WHERE c_n = 0
  UNION ALL SELECT column_name, 'range_min' FROM j WHERE c_n > 0 AND c_min < r_min * 0.5 - abs(r_min)
  UNION ALL SELECT column_name, 'range_max' FROM j WHERE c_n > 0 AND c_max > r_max * 2.0 + abs(r_max))""",
        _STATS_CTES,
    ),
)
def distribution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current period vs reference stats — existence, non-empty, mean drift (3σ), generous min/max bounds."""
    ref, cur = _split(spark, sf_dir)
    return dr.distribution_violations(cur, _ref_stats(ref), 3.0)


@register(
    "label_drift",
    with_bookings(
        """
SELECT round(r, 6) AS ref_positive_rate, round(c, 6) AS cur_positive_rate, round(abs(c - r), 6) AS drift_magnitude,
       abs(c - r) > 0.10 AS is_drifted
FROM (SELECT avg(CASE WHEN period = 'ref' THEN CAST(y AS DOUBLE) END) AS r,
             coalesce(avg(CASE WHEN period = 'cur' THEN CAST(y AS DOUBLE) END), 0.0) AS c FROM bookings)"""
    ),
)
def label_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current positive rate of y vs the reference-period rate, tolerance 0.10."""
    ref, cur = _split(spark, sf_dir)
    ref_rate = ref.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    out = dr.label_drift(cur, "y", ref_rate, 0.10)
    return out.select(
        rnd(F.col("ref_positive_rate")).alias("ref_positive_rate"),
        rnd(F.col("cur_positive_rate")).alias("cur_positive_rate"),
        rnd(F.col("drift_magnitude")).alias("drift_magnitude"),
        "is_drifted",
    )


def _pair_corr_ctes(cols, source, name):
    body = corr_list_sql([(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]] + [(c, "y") for c in cols], source)
    return f"{name}_p AS ({body}),\n{name} AS (SELECT a, b, r FROM {name}_p UNION ALL SELECT b AS a, a AS b, r FROM {name}_p)"


_TRACKED = f"""{_CUR_REF},
{_pair_corr_ctes(DRIFT_COLS, 'ref', 'rc')},
{_pair_corr_ctes(DRIFT_COLS, 'cur', 'cc')},
rk AS (SELECT a AS f, r, row_number() OVER (ORDER BY abs(r) DESC, idx) AS k
       FROM rc JOIN (SELECT unnest({DRIFT_COLS!r}) AS f, generate_subscripts({DRIFT_COLS!r}, 1) AS idx) o ON o.f = rc.a
       WHERE rc.b = 'y' AND r IS NOT NULL AND NOT isnan(r)),
top AS (SELECT * FROM rk WHERE k <= {CORR_TOP_K}),
tracked AS (SELECT x.f AS a, y2.f AS b FROM top x JOIN top y2 ON x.k < y2.k UNION ALL SELECT f AS a, 'y' AS b FROM top)"""


@register(
    "correlation_drift",
    with_bookings(
        """
SELECT t.a || '__' || t.b AS pair, round(r1.r, 6) AS ref_corr, round(r2.r, 6) AS cur_corr,
       round(abs(r2.r - r1.r), 6) AS delta, coalesce(abs(r2.r - r1.r) > 0.20, false) AS drifted
FROM tracked t JOIN rc r1 ON r1.a = t.a AND r1.b = t.b JOIN cc r2 ON r2.a = t.a AND r2.b = t.b""",
        _TRACKED,
    ),
)
def correlation_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked reference pairs (top-20 by |r with y|) re-measured on the current period; |Δr| > 0.20 drifts."""
    ref, cur = _split(spark, sf_dir)
    reference = pf.reference_correlations(ref, DRIFT_COLS, "y", CORR_TOP_K)
    rows = dr.correlation_drift(cur, reference, 0.20)

    def r6(v):
        return None if v is None else pround(v, 6)

    out = [(k, r6(a), r6(b), r6(d), bool(f)) for k, a, b, d, f in rows]
    return spark.createDataFrame(out, "pair string, ref_corr double, cur_corr double, delta double, drifted boolean")


@register(
    "serving_skew",
    with_bookings(
        """
SELECT column_name, round(r_mean, 6) AS ref_mean, round(c_mean, 6) AS cur_mean, round(abs(c_mean - r_mean) / r_std, 6) AS z_score
FROM j WHERE c_n > 0 AND r_std > 0 AND abs(c_mean - r_mean) > 2.0 * r_std""",
        _STATS_CTES,
    ),
)
def serving_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose current mean moved more than 2σ of the reference; z score."""
    ref, cur = _split(spark, sf_dir)
    out = dr.serving_skew(cur, _ref_stats(ref), DRIFT_COLS, 2.0)
    return out.select("column_name", rnd(F.col("ref_mean")).alias("ref_mean"), rnd(F.col("cur_mean")).alias("cur_mean"), rnd(F.col("z_score")).alias("z_score"))


def _importance_table(df: DataFrame) -> DataFrame:
    """Importance proxy from data: |Pearson r| of each feature with y (O(features) rows)."""
    r = pf.pair_correlations(df, [(c, "y") for c in DRIFT_COLS])
    rows = [(c, abs(v) if v is not None else 0.0) for (c, _), v in r.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


_IMP_CTES = (
        _CUR_REF
        + ",\n"
        + "ri0 AS ("
        + "\n  UNION ALL ".join(
            f"SELECT '{c}' AS feature, coalesce(abs(corr(CAST({c} AS DOUBLE), CAST(y AS DOUBLE))), 0.0) AS imp FROM ref" for c in DRIFT_COLS
        )
        + "),\nci0 AS ("
        + "\n  UNION ALL ".join(
            f"SELECT '{c}' AS feature, coalesce(abs(corr(CAST({c} AS DOUBLE), CAST(y AS DOUBLE))), 0.0) AS imp FROM cur" for c in DRIFT_COLS
        )
        + "),\nri AS (SELECT feature, imp, row_number() OVER (ORDER BY imp DESC, feature) - 1 AS rk FROM ri0),"
        + "\nci AS (SELECT feature, imp, row_number() OVER (ORDER BY imp DESC, feature) - 1 AS rk FROM ci0)"
)


@register(
    "importance_drift",
    with_bookings(
        """
SELECT t.feature, t.ref_rank, t.cur_rank, t.rank_change, round(t.ref_importance, 6) AS ref_importance,
       round(t.cur_importance, 6) AS cur_importance, abs(t.rank_change) >= 5 AS changed, round(s.rho, 6) AS rank_correlation
FROM (SELECT r.feature, r.rk AS ref_rank, c.rk AS cur_rank, c.rk - r.rk AS rank_change,
             r.imp AS ref_importance, c.imp AS cur_importance
      FROM ri r JOIN ci c USING (feature) WHERE r.rk < 10) t,
     (SELECT CASE WHEN count(*) >= 3 THEN corr(CAST(r.rk AS DOUBLE), CAST(c.rk AS DOUBLE)) END AS rho
      FROM ri r JOIN ci c USING (feature)) s""",
        _IMP_CTES,
    ),
)
def importance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank features by importance (|r with y|) per period; rank moves ≥ 5 in the
    reference top 10 flag a change; Spearman rank correlation over shared features."""
    ref, cur = _split(spark, sf_dir)
    out = dr.importance_drift(_importance_table(cur), _importance_table(ref), 10, 5)
    return out.select(
        "feature", F.col("ref_rank").cast("long").alias("ref_rank"), F.col("cur_rank").cast("long").alias("cur_rank"),
        F.col("rank_change").cast("long").alias("rank_change"),
        rnd(F.col("ref_importance")).alias("ref_importance"), rnd(F.col("cur_importance")).alias("cur_importance"),
        "changed", rnd(F.col("rank_correlation")).alias("rank_correlation"),
    )


def _div_query(cols, metric):
    return with_bookings(
        "SELECT column_name, round(score, 6) AS score FROM scores",
        binned_counts_ctes(long_union(cols)) + "," + divergence_select(metric),
    )


@register("psi_numeric", _div_query(["lead_time"], "psi"))
def psi_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI of lead_time, reference vs current period, 10 equal-width bins on the joint range."""
    ref, cur = _split(spark, sf_dir)
    out = dr.divergence(dr.binned_counts(ref, cur, ["lead_time"], 10), 10, "psi")
    return out.select("column_name", rnd(F.col("score")).alias("score"))


@register("js_divergence", _div_query(["adr"], "js"))
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jensen–Shannon divergence (log2, clipped to [0,1]) of adr, reference vs current period."""
    ref, cur = _split(spark, sf_dir)
    out = dr.divergence(dr.binned_counts(ref, cur, ["adr"], 10), 10, "js")
    return out.select("column_name", rnd(F.col("score")).alias("score"))


@register(
    "psi_multi",
    with_bookings(
        """
SELECT column_name, round(score, 6) AS score,
       CASE WHEN score >= (CASE WHEN column_name = 'lead_time' THEN 0.15 WHEN column_name = 'adr' THEN 0.10 ELSE 0.25 END) THEN 'drift'
            WHEN score >= (CASE WHEN column_name = 'lead_time' THEN 0.15 ELSE 0.10 END) THEN 'warn' ELSE 'stable' END AS status
FROM scores WHERE n_ref >= 5 AND n_cur >= 5""",
        binned_counts_ctes(long_union(DRIFT_COLS)) + "," + divergence_select("psi"),
    ),
)
def psi_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI for every numeric column in one long-form pass; warn 0.10 / block 0.25, lead_time override 0.15,
    adr critical (block = warn); columns with < 5 values per side skipped."""
    ref, cur = _split(spark, sf_dir)
    return dr.drift_scores(ref, cur, DRIFT_COLS, 10, "psi", 0.10, 0.25, THRESHOLD_OVERRIDES, CRITICAL)


_CAT_PSI_CTES = """
cl AS (SELECT period AS side, column_name, coalesce(value, '<NA>') AS value FROM (
  SELECT period, 'hotel' AS column_name, CAST(hotel AS VARCHAR) AS value FROM bookings UNION ALL
  SELECT period, 'country', CAST(country AS VARCHAR) FROM bookings UNION ALL
  SELECT period, 'market_segment', CAST(market_segment AS VARCHAR) FROM bookings UNION ALL
  SELECT period, 'customer_type', CAST(customer_type AS VARCHAR) FROM bookings UNION ALL
  SELECT period, 'arrival_date_month', CAST(arrival_date_month AS VARCHAR) FROM bookings)),
cc AS (SELECT column_name, value, count_if(side = 'ref') AS n_ref, count_if(side = 'cur') AS n_cur FROM cl GROUP BY ALL),
ct AS (SELECT column_name, sum(n_ref) AS t_ref, sum(n_cur) AS t_cur FROM cc GROUP BY ALL),
sh AS (SELECT cc.column_name, greatest(coalesce(n_ref / CAST(t_ref AS DOUBLE), 0.0), 1e-9) AS r,
              greatest(coalesce(n_cur / CAST(t_cur AS DOUBLE), 0.0), 1e-9) AS c FROM cc JOIN ct USING (column_name)),
nm AS (SELECT column_name, r / sum(r) OVER (PARTITION BY column_name) AS r, c / sum(c) OVER (PARTITION BY column_name) AS c FROM sh),
cpsi AS (SELECT column_name, sum((c - r) * ln(c / r)) AS psi FROM nm GROUP BY column_name)"""


@register("psi_categorical", with_bookings("SELECT column_name, round(psi, 6) AS psi FROM cpsi", _CAT_PSI_CTES))
def psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical PSI per column over the union of categories (NULL is a category)."""
    ref, cur = _split(spark, sf_dir)
    return dr.categorical_psi(ref, cur, CATEGORY_COLS).select("column_name", rnd(F.col("psi")).alias("psi"))


@register(
    "data_drift_report",
    with_bookings(
        """
SELECT feature, type, round(psi, 6) AS psi, round(ref_mean, 6) AS ref_mean, round(cur_mean, 6) AS cur_mean,
       round(max(psi) OVER (), 6) AS max_psi, round(avg(psi) OVER (), 6) AS mean_psi
FROM (SELECT s.column_name AS feature, 'numeric' AS type, s.score AS psi, m.ref_mean, m.cur_mean
      FROM scores s JOIN means m ON m.column_name = s.column_name
      UNION ALL SELECT column_name, 'categorical', psi, NULL, NULL FROM cpsi)""",
        binned_counts_ctes(long_union(DRIFT_COLS))
        + ","
        + divergence_select("psi")
        + ",\nmeans AS (SELECT column_name, avg(CASE WHEN side = 'ref' THEN value END) AS ref_mean, "
        + "avg(CASE WHEN side = 'cur' THEN value END) AS cur_mean FROM long GROUP BY column_name),"
        + _CAT_PSI_CTES,
    ),
)
def data_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-feature PSI (numeric with means, categorical), plus max and mean PSI over features."""
    ref, cur = _split(spark, sf_dir)
    num = dr.divergence(dr.binned_counts(ref, cur, DRIFT_COLS, 10), 10, "psi")
    long = dr._sided_long(ref, cur, DRIFT_COLS)
    means = long.groupBy("column_name").agg(
        F.avg(F.when(F.col("side") == "ref", F.col("value"))).alias("ref_mean"),
        F.avg(F.when(F.col("side") == "cur", F.col("value"))).alias("cur_mean"),
    )
    numeric = num.join(means, "column_name").select(
        F.col("column_name").alias("feature"), F.lit("numeric").alias("type"), F.col("score").alias("psi"), "ref_mean", "cur_mean"
    )
    cat = dr.categorical_psi(ref, cur, CATEGORY_COLS).select(
        F.col("column_name").alias("feature"), F.lit("categorical").alias("type"), "psi",
        F.lit(None).cast("double").alias("ref_mean"), F.lit(None).cast("double").alias("cur_mean"),
    )
    feats = numeric.unionByName(cat).collect()  # one row per feature
    psis = [r["psi"] for r in feats if r["psi"] is not None]
    max_psi = max(psis) if psis else 0.0
    mean_psi = sum(psis) / len(psis) if psis else 0.0
    rows = [
        (r["feature"], r["type"], pround(r["psi"]), pround(r["ref_mean"]), pround(r["cur_mean"]), pround(max_psi), pround(mean_psi))
        for r in feats
    ]
    return spark.createDataFrame(
        rows, "feature string, type string, psi double, ref_mean double, cur_mean double, max_psi double, mean_psi double"
    )


_PRED_CTES = (
    """
pts AS (SELECT period AS side, CAST(score AS DOUBLE) AS x FROM bookings WHERE score IS NOT NULL),
hb AS (SELECT side, """
    + bin_expr("x", "0.0", "1.0", 10)
    + """ AS bin FROM pts WHERE x >= 0.0 AND x <= 1.0),
grid AS (SELECT s.side, unnest(range(0, 10)) AS bin FROM (SELECT 'ref' AS side UNION ALL SELECT 'cur') s),
hc AS (SELECT g.side, g.bin, coalesce(count(hb.bin), 0) AS n FROM grid g LEFT JOIN hb ON hb.side = g.side AND hb.bin = g.bin GROUP BY ALL),
sh0 AS (SELECT side, bin, greatest(CASE WHEN sum(n) OVER (PARTITION BY side) <= 0 THEN 0.1
                                        ELSE n / CAST(sum(n) OVER (PARTITION BY side) AS DOUBLE) END, 1e-9) AS p FROM hc),
sh AS (SELECT side, bin, p / sum(p) OVER (PARTITION BY side) AS p FROM sh0),
g2 AS (SELECT x, count_if(side = 'ref') AS a, count_if(side = 'cur') AS b FROM pts GROUP BY x),
cum AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb FROM g2),
tot AS (SELECT greatest(count_if(side = 'ref'), 1) AS na, greatest(count_if(side = 'cur'), 1) AS nb FROM pts)"""
)
_PRED_SQL = with_bookings(
    """
SELECT round(p.psi, 6) AS psi, round(k.ks_stat, 6) AS ks_stat, round(m.ref_mean_proba, 6) AS ref_mean_proba,
       round(m.cur_mean_proba, 6) AS cur_mean_proba
FROM (SELECT sum((c.p - r.p) * ln(c.p / r.p)) AS psi FROM sh r JOIN sh c ON r.bin = c.bin AND r.side = 'ref' AND c.side = 'cur') p,
     (SELECT coalesce(max(abs(ca / na - cb / nb)), 0.0) AS ks_stat FROM cum, tot) k,
     (SELECT coalesce(avg(CASE WHEN period = 'ref' THEN score END), 0.0) AS ref_mean_proba,
             coalesce(avg(CASE WHEN period = 'cur' THEN score END), 0.0) AS cur_mean_proba FROM bookings) m""",
    _PRED_CTES,
)


@register("prediction_drift", _PRED_SQL)
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score drift — PSI on 10 fixed [0,1] bins (clip 1e-9, renormalise), KS statistic, mean scores."""
    ref, cur = _split(spark, sf_dir)
    out = dr.prediction_drift(ref, cur, "score", 10)
    return out.select(*[rnd(F.col(c)).alias(c) for c in ("psi", "ks_stat", "ref_mean_proba", "cur_mean_proba")])


@register(
    "ks_stat",
    with_bookings(
        """
SELECT round(coalesce(max(abs(ca / na - cb / nb)), 0.0), 6) AS ks_stat FROM cum, tot""",
        """
pts AS (SELECT period AS side, CAST(adr AS DOUBLE) AS x FROM bookings WHERE adr IS NOT NULL AND NOT isnan(adr)),
g2 AS (SELECT x, count_if(side = 'ref') AS a, count_if(side = 'cur') AS b FROM pts GROUP BY x),
cum AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb FROM g2),
tot AS (SELECT greatest(count_if(side = 'ref'), 1) AS na, greatest(count_if(side = 'cur'), 1) AS nb FROM pts)""",
    ),
)
def ks_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample KS statistic of adr (reference vs current) from running counts over grouped points."""
    ref, cur = _split(spark, sf_dir)
    return dr.ks_statistic(ref, cur, "adr").select(rnd(F.col("ks_stat")).alias("ks_stat"))
