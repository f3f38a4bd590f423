"""Named queries for sources/sinks, lineage, schema checks, ops gates and knowledge-base upkeep."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.catalog.drift import _CAT_PSI_CTES, CATEGORY_COLS, DRIFT_COLS
from driftwise.catalog.sqlgen import binned_counts_ctes, divergence_select, long_union
from driftwise.catalog.text import INGEST_CTES
from driftwise.functions.scalar import pround, rnd, to_double
from driftwise.operators import anomaly as an
from driftwise.operators import checks as ck
from driftwise.operators import drift as dr
from driftwise.operators import models as md
from driftwise.operators import text as tx
from driftwise.operators.evaluate import roc_auc
from driftwise.sources import files as fs
from driftwise.sources import versions as vs
from driftwise.sources.tables import TABLES, bookings, table
from driftwise.streaming import windows as wn

AS_OF = "2024-03-01 00:00:00"
STALE_DAYS = 90


@register(
    "staleness_check",
    f"""SELECT name, strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest,
       round(epoch(TIMESTAMP '{AS_OF}' - newest) / 86400.0, 6) AS age_days,
       epoch(TIMESTAMP '{AS_OF}' - newest) / 86400.0 > {STALE_DAYS} AS is_stale
FROM (SELECT 'events' AS name, max(ts) AS newest FROM events UNION ALL
      SELECT 'orders', max(o_orderdate) FROM orders UNION ALL
      SELECT 'lineitem', max(l_shipdate) FROM lineitem)""",
)
def staleness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest timestamp of each time-stamped table vs the as-of date; stale beyond 90 days."""
    parts = []
    for name, col in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        parts.append(table(spark, sf_dir, name).agg(F.max(col).alias("newest")).select(F.lit(name).alias("name"), "newest"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / F.lit(86400e6)
    return out.select("name", F.date_format("newest", wn.TS_FORMAT).alias("newest"), rnd(age).alias("age_days"),
                      (age > F.lit(float(STALE_DAYS))).alias("is_stale"))


@register(
    "csv_roundtrip",
    with_bookings(
        """
SELECT period, count(*) AS n_rows, CAST(sum(lead_time) AS BIGINT) AS sum_lead_time,
       count(adr) AS n_adr, round(avg(adr), 4) AS avg_adr
FROM bookings GROUP BY period"""
    ),
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings written as header CSV into a ``hotel_bookings.csv`` folder, read back through the
    suffix dispatcher (name-based type hints, PERMISSIVE), summarised per period."""
    path = fs.scratch_path(spark, "csv") + "/hotel_bookings.csv"
    bookings(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    back = fs.read_input_dataset(spark, path)
    return back.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("lead_time").cast("long").alias("sum_lead_time"),
        F.count("adr").alias("n_adr"), rnd(F.avg("adr"), 4).alias("avg_adr"),
    )


_SEGMENT_SUMMARY_SQL = with_bookings(
    """
SELECT period AS run_id, customer_type, count(*) AS n_rows, round(avg(score), 6) AS mean_score, CAST(sum(y) AS BIGINT) AS n_positive
FROM bookings GROUP BY ALL"""
)


@register("snapshot_upsert", _SEGMENT_SUMMARY_SQL)
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run snapshot rows upserted by run id (dynamic partition overwrite): a first write of the current run
    from the order table alone is replaced by the full snapshot, the reference run is left untouched."""
    b = bookings(spark, sf_dir)
    snap = b.groupBy(F.col("period").alias("run_id"), "customer_type").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("score")).alias("mean_score"), F.sum("y").cast("long").alias("n_positive")
    )
    path = fs.scratch_path(spark, "snapshots")
    fs.upsert_snapshot(snap.where(F.col("run_id") == "ref"), path)
    stale = snap.where(F.col("run_id") == "cur").withColumn("n_rows", F.lit(0).cast("long"))
    fs.upsert_snapshot(stale, path)
    fs.upsert_snapshot(snap.where(F.col("run_id") == "cur"), path)
    return spark.read.parquet(path).select("run_id", "customer_type", "n_rows", "mean_score", "n_positive")


@register(
    "recent_runs",
    """
SELECT strftime(o_orderdate, '%Y-%m') AS run_id, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS n_rows,
       round(sum(o_totalprice), 2) AS total_price
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly runs over the orders, stored as run snapshots; the 20 that were updated last."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    runs = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).agg(
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("updated_at"), F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum("o_totalprice"), 2).alias("total_price"),
    )
    path = fs.scratch_path(spark, "runs")
    fs.upsert_snapshot(runs, path)
    stored = spark.read.schema(runs.schema).parquet(path).select("run_id", "updated_at", "n_rows", "total_price")
    return fs.recent_runs(stored)


@register(
    "dead_letter",
    with_bookings(
        """
SELECT count(*) AS n_dead_letters, count(DISTINCT booking_id) AS n_bookings, min(booking_id) AS first_booking
FROM bookings WHERE lead_time < 0 OR lead_time > 3650 OR adults < 1 OR adults > 20 OR children < 0 OR children > 20
   OR babies < 0 OR babies > 10 OR stays_in_week_nights < 0 OR stays_in_week_nights > 365
   OR stays_in_weekend_nights < 0 OR stays_in_weekend_nights > 365 OR adr < 0 OR adr > 100000
   OR hotel NOT IN ('Resort Hotel', 'City Hotel')"""
    ),
)
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows failing the record constraints appended to a dead-letter folder as (created_at, payload JSON),
    read back and counted."""
    b = bookings(spark, sf_dir).drop("booked_on")
    _, bad = ck.split_by_contract(b, ck.guest_record_contract(b.columns))
    path = fs.scratch_path(spark, "dead-letter")
    fs.append_dead_letter(bad, path, created_at="2024-01-01 00:00:00")
    back = spark.read.json(path)
    ids = F.get_json_object("payload", "$.booking_id").cast("long")
    return back.agg(F.count(F.lit(1)).alias("n_dead_letters"), F.countDistinct(ids).alias("n_bookings"), F.min(ids).alias("first_booking"))


@register("file_checksums")
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 and size of every input table file, computed on executors."""
    out = fs.file_checksums(spark, f"{sf_dir.rstrip('/')}/*.parquet")
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", "sha256")


def _fingerprint(df: DataFrame) -> str:
    info = {"columns": sorted(df.columns), "dtypes": {f.name: f.dataType.simpleString() for f in sorted(df.schema.fields, key=lambda f: f.name)},
            "n_columns": len(df.columns)}
    return hashlib.sha256(json.dumps(info, sort_keys=True).encode()).hexdigest()[:16]


@register("schema_fingerprint")
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6/V4: schema fingerprint (sorted columns + types, 16 hex of SHA-256) of every table, with its row count,
    NULL cells and a duplicate-column-name check."""
    rows = []
    for name in TABLES:
        df = table(spark, sf_dir, name)
        stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
        nulls = sum(stats[f"c{i}"] for i in range(len(df.columns)))
        rows.append((name, len(df.columns), _fingerprint(df), int(stats["n"]), int(nulls), len(set(df.columns)) == len(df.columns)))
    return spark.createDataFrame(rows, "table_name string, n_columns int, fingerprint string, n_rows long, n_null_cells long, unique_names boolean")


@register("lineage_record")
def lineage_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lineage record per preprocessing run (reference, then current period): rows, columns, schema
    fingerprint, duplicate and anomaly counts, and the previous run's row count as the next volume expectation."""
    b = bookings(spark, sf_dir)
    path = fs.scratch_path(spark, "lineage")
    for seq, period in enumerate(("ref", "cur")):
        part = b.where(F.col("period") == period)
        dup = an.duplicate_report(part).first()["n_duplicates"]
        anom = an.row_anomaly_counts(part).first()["n_anomalies"]
        fs.append_lineage(spark, path, {"run_seq": seq, "run_id": period, "n_rows": part.count(), "n_columns": len(part.columns),
                                        "fingerprint": _fingerprint(part), "n_duplicates": int(dup), "n_anomalies": int(anom)})
    lin = spark.read.parquet(path)
    w = Window.orderBy("run_seq")  # one row per run
    return lin.withColumn("previous_n_rows", F.lag("n_rows").over(w)).select(
        "run_seq", "run_id", "n_rows", "n_columns", "fingerprint", "n_duplicates", "n_anomalies", "previous_n_rows"
    )


FEATURE_NUMERIC = ["lead_time", "adr", "arrival_date_month", "booking_changes"]
FEATURE_CATEGORICAL = ["hotel", "country"]


@register(
    "prepare_features",
    with_bookings(
        """
SELECT * FROM (
  SELECT 'lead_time' AS column_name, 'numeric' AS kind, false AS added_missing,
         count_if(lead_time IS NOT NULL AND TRY_CAST(lead_time AS DOUBLE) IS NULL) AS n_non_numeric FROM bookings UNION ALL
  SELECT 'adr', 'numeric', false, count_if(adr IS NOT NULL AND TRY_CAST(adr AS DOUBLE) IS NULL) FROM bookings UNION ALL
  SELECT 'arrival_date_month', 'numeric', false,
         count_if(arrival_date_month IS NOT NULL AND TRY_CAST(arrival_date_month AS DOUBLE) IS NULL) FROM bookings UNION ALL
  SELECT 'booking_changes', 'numeric', true, 0 UNION ALL
  SELECT 'hotel', 'categorical', false, 0 UNION ALL
  SELECT 'country', 'categorical', false, 0)"""
    ),
)
def prepare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project bookings onto a feature spec (missing column added as NULL, extras ignored, order
    frozen), coerce numerics and report values that fail parsing, cast categoricals to string."""
    b = bookings(spark, sf_dir)
    present = set(b.columns)
    cols = []
    for c in FEATURE_NUMERIC:
        cols.append((F.col(c) if c in present else F.lit(None).cast("string")).alias(c))
    for c in FEATURE_CATEGORICAL:
        cols.append((F.col(c).cast("string") if c in present else F.lit(None).cast("string")).alias(c))
    work = b.select(*cols)
    bad = work.agg(*[F.count_if(F.col(c).isNotNull() & to_double(F.col(c).cast("string")).isNull()).alias(c) for c in FEATURE_NUMERIC]).first()
    rows = [(c, "numeric", c not in present, int(bad[c])) for c in FEATURE_NUMERIC]
    rows += [(c, "categorical", c not in present, 0) for c in FEATURE_CATEGORICAL]
    return spark.createDataFrame(rows, "column_name string, kind string, added_missing boolean, n_non_numeric long")


MODEL_FIELDS = ["lead_time", "adults", "children", "stays_in_week_nights", "stays_in_weekend_nights", "hotel", "market_segment"]


def _risk_score(lead: F.Column) -> F.Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(lead.cast("double") - F.lit(450.0)) / F.lit(150.0)))


@register(
    "selective_rescore",
    with_bookings(
        """
SELECT o.booking_id, coalesce(c.lead_time, o.lead_time) AS lead_time, c.booking_id IS NOT NULL AND c.lead_time IS NOT NULL
         AND c.lead_time IS DISTINCT FROM o.lead_time AS rescored,
       round(CASE WHEN c.lead_time IS NOT NULL AND c.lead_time IS DISTINCT FROM o.lead_time
                  THEN 1.0 / (1.0 + exp(-(CAST(c.lead_time AS DOUBLE) - 450.0) / 150.0))
                  ELSE 1.0 / (1.0 + exp(-(CAST(o.lead_time AS DOUBLE) - 450.0) / 150.0)) END, 6) AS risk_score
FROM bookings o LEFT JOIN
  (SELECT l_orderkey AS booking_id, CAST(max(datediff('day', o_orderdate, l_shipdate)) AS INTEGER) AS lead_time
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) c ON c.booking_id = o.booking_id"""
    ),
)
def selective_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-row merge of a change set (new non-NULL values win) and re-scoring of only the rows
    whose model fields changed.  The change set sets lead_time to the longest ship delay of each order."""
    old = bookings(spark, sf_dir).select("booking_id", *MODEL_FIELDS)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    changes = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_orderkey").alias("booking_id")).agg(
        F.max(F.datediff("l_shipdate", "o_orderdate")).cast("int").alias("lead_time")
    )
    new_cols = [c for c in changes.columns if c != "booking_id"]
    merged = old.join(changes.select("booking_id", *[F.col(c).alias(f"_new_{c}") for c in new_cols]), "booking_id", "left")
    changed = F.lit(False)
    for c in new_cols:
        changed = changed | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    out = merged.select(
        "booking_id", *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in new_cols], changed.alias("rescored"),
        F.col("lead_time").alias("_old_lead"),
    )
    score = F.when(F.col("rescored"), _risk_score(F.col("lead_time"))).otherwise(_risk_score(F.col("_old_lead")))
    return out.select("booking_id", "lead_time", "rescored", rnd(score).alias("risk_score"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ok, _ = tx.ingest_chunks(docs, "doc_id", "source", "text")
    return ok.join(docs.select("doc_id", F.col("lang").alias("category")), "doc_id").select(
        "chunk_id", "doc_id", "category", "title", "content", F.lit(True).alias("is_active"), F.lit(None).cast("array<float>").alias("embedding")
    )


def _merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change set = soft-delete every chunk whose content repeats an earlier chunk (by chunk id);
    full outer merge base ⟗ changes, new non-NULL values win."""
    path = fs.scratch_path(spark, "chunks")
    _chunks(spark, sf_dir).write.parquet(path)  # chunked once, read three times
    base = spark.read.parquet(path)
    hashed = base.select("chunk_id", F.md5("content").alias("_h"))
    first = hashed.groupBy("_h").agg(F.min("chunk_id").alias("_first"))
    dups = hashed.join(first, "_h").where(F.col("chunk_id") != F.col("_first"))
    changes = dups.select("chunk_id", F.lit(False).alias("_new_active"))
    m = base.join(changes, "chunk_id", "full_outer")
    return m.withColumn("is_active", F.coalesce("_new_active", "is_active")).drop("_new_active")


_MERGED_SQL = f"""WITH {INGEST_CTES},
h AS (SELECT chunk_id, md5(content) AS hsh FROM chunks),
f AS (SELECT hsh, min(chunk_id) AS first_id FROM h GROUP BY hsh),
m AS (SELECT c.*, c.chunk_id = f.first_id AS is_active FROM chunks c JOIN h USING (chunk_id) JOIN f USING (hsh))"""


@register(
    "knowledge_stats",
    _MERGED_SQL
    + """
SELECT coalesce(category, 'uncategorized') AS category, count(*) AS total_chunks, count_if(is_active) AS active_chunks,
       count_if(NOT is_active) AS inactive_chunks, CAST(0 AS BIGINT) AS embedded_chunks FROM m GROUP BY 1""",
)
def knowledge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge chunks after the duplicate soft-delete merge — per category total, active,
    inactive and embedded counts."""
    m = _merged_chunks(spark, sf_dir)
    return m.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if("is_active").alias("active_chunks"),
        F.count_if(~F.col("is_active")).alias("inactive_chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded_chunks"),
    )


def _knowledge_changes(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """Change set from the tables: repeated contents are deleted, chunks of documents labelled bad get the category
    ``review`` and a new title, and every benchmark passage becomes a chunk."""
    cols = ["chunk_id", "op", F.lit(1).alias("seq"), "category", "title", "content"]
    none = F.lit(None).cast("string")
    hashed = base.select("chunk_id", F.md5("content").alias("_h"))
    first = hashed.groupBy("_h").agg(F.min("chunk_id").alias("_first"))
    gone = hashed.join(first, "_h").where(F.col("chunk_id") != F.col("_first")).withColumns(
        {"op": F.lit("delete"), "category": none, "title": none, "content": none})
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    review = base.select("chunk_id", "doc_id", F.col("title").alias("_title")).join(bad, "doc_id").withColumns(
        {"op": F.lit("update"), "category": F.lit("review"), "title": F.concat(F.lit("Review: "), "_title"), "content": none})
    new = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark-"), F.col("item_id").cast("string")).alias("chunk_id"), F.lit("insert").alias("op"),
        F.lit("benchmark").alias("category"), none.alias("title"), F.col("text").alias("content"))
    return gone.select(*cols).unionByName(review.select(*cols)).unionByName(new.select("chunk_id", "op", F.lit(1).alias("seq"), "category", "title", "content"))


@register(
    "knowledge_merge",
    _MERGED_SQL
    + """,
b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT chunk_id, CASE WHEN b.doc_id IS NULL THEN category ELSE 'review' END AS category,
       CASE WHEN b.doc_id IS NULL THEN title ELSE 'Review: ' || title END AS title, md5(content) AS content_md5, is_active
FROM m LEFT JOIN b USING (doc_id)
UNION ALL SELECT 'benchmark-' || CAST(item_id AS VARCHAR), 'benchmark', NULL, md5(text), true FROM benchmark""",
)
def knowledge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge chunks as a versioned table; one change set inserts, updates and soft-deletes rows, and the
    merged version comes into force by a switched pointer.  The result is the version then in force."""
    root = fs.scratch_path(spark, "knowledge")
    vs.write_version(_chunks(spark, sf_dir), root)
    vs.merge_version(spark, root, _knowledge_changes(spark, sf_dir, vs.read_version(spark, root)), "chunk_id", stale={"embedding": ("title", "content")})
    return vs.read_version(spark, root).select("chunk_id", "category", "title", F.md5("content").alias("content_md5"), "is_active")


@register(
    "embed_missing",
    _MERGED_SQL
    + """
SELECT chunk_id, category, CAST(length(title || '. ' || content) AS INTEGER) AS text_len, md5(title || '. ' || content) AS text_md5
FROM m WHERE is_active""",
)
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active chunks without an embedding and the text to embed ('title. content'); an embedding
    ``pandas_udf`` plugs in here."""
    m = _merged_chunks(spark, sf_dir)
    todo = m.where(F.col("is_active") & F.col("embedding").isNull())
    return todo.select("chunk_id", "category", F.length(F.concat_ws(". ", "title", "content")).alias("text_len"),
                       F.md5(F.concat_ws(". ", "title", "content")).alias("text_md5"))


@register(
    "model_health",
    with_bookings(
        """
SELECT 'roc_auc' AS signal, round(auc, 6) AS value, 0.65 AS "limit", auc < 0.65 AS breached FROM oa
UNION ALL SELECT 'psi:' || column_name, round(score, 6), 0.2, score > 0.2 FROM scores
UNION ALL SELECT 'psi:' || column_name, round(psi, 6), 0.2, psi > 0.2 FROM cpsi""",
        binned_counts_ctes(long_union(DRIFT_COLS)) + "," + divergence_select("psi") + ","
        + _CAT_PSI_CTES + """,
ob AS (SELECT score AS p, y FROM bookings WHERE period = 'cur'),
og AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ob GROUP BY p),
oc AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM og),
oa AS (SELECT sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM oc)""",
    ),
)
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-health gauges against their limits — current-period AUC < 0.65 and per-feature PSI > 0.2."""
    b = bookings(spark, sf_dir)
    ref, cur = b.where(F.col("period") == "ref"), b.where(F.col("period") == "cur")
    auc = roc_auc(cur, "score", "y").first()[0]
    num = dr.divergence(dr.binned_counts(ref, cur, DRIFT_COLS, 10), 10, "psi").select("column_name", F.col("score").alias("v"))
    cat = dr.categorical_psi(ref, cur, CATEGORY_COLS).select("column_name", F.col("psi").alias("v"))
    psi = num.unionByName(cat).select(
        F.concat(F.lit("psi:"), "column_name").alias("signal"), rnd(F.col("v")).alias("value"), F.lit(0.2).alias("limit"),
        (F.col("v") > F.lit(0.2)).alias("breached"),
    )
    head = spark.createDataFrame([("roc_auc", pround(auc), 0.65, bool(auc is not None and auc < 0.65))], "signal string, value double, limit double, breached boolean")
    return head.unionByName(psi)


@register("rollback_matrix")
def rollback_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hourly window, the correlated rollback rule — model/business reasons (profit drop, prediction
    drift, data drift with action-rate deviation from the monitoring alerts) AND 5xx breach AND p95 breach —
    with the non-rollback signals (volume anomaly, ops without model quality, model quality without ops, fast burn)."""
    from driftwise.catalog.monitoring import _alerts

    a = _alerts(spark, sf_dir)
    reasons = []
    if a["profit_drop"]:
        reasons.append("profit_drop")
    if a["prediction_drift"]:
        reasons.append("prediction_drift")
    if a["data_drift"] and a["action_rate_deviation"]:
        reasons.append("data_drift+action_rate_deviation")
    log = wn.request_log(wn.event_time(table(spark, sf_dir, "events")))
    er = wn.error_ratio(log).select("window_start", "error_ratio", F.col("breach").alias("high_5xx"))
    ph = wn.latency_p95(log).select("window_start", F.col("slo_breach").alias("high_p95"))
    burn = wn.burn_rate(log).select(F.col("window_end"), "fast_burn")
    ops = er.join(ph, "window_start").join(
        burn.withColumn("window_start", F.date_format(F.to_timestamp("window_end", wn.TS_FORMAT) - F.expr("INTERVAL 1 HOUR"), wn.TS_FORMAT)),
        "window_start", "left",
    )
    has_reasons = F.lit(bool(reasons))
    pair = F.coalesce(F.col("high_5xx"), F.lit(False)) & F.coalesce(F.col("high_p95"), F.lit(False))
    rollback = has_reasons & pair
    reason_arr = F.when(rollback, F.array(*[F.lit(r) for r in ["correlated_5xx+latency+model_quality", *reasons]]))
    signals = F.array_compact(F.array(
        F.when(F.lit(bool(a["data_volume_anomaly"])), F.lit("data_volume_anomaly")),
        F.when(has_reasons & ~pair, F.lit("model_quality_without_ops_correlation")),
        F.when(pair & ~has_reasons, F.lit("ops_correlation_without_model_quality")),
        F.when(F.coalesce(F.col("fast_burn"), F.lit(False)), F.lit("error_budget_burn_fast")),
    ))
    return ops.select(
        "window_start", "high_5xx", "high_p95", F.coalesce("fast_burn", F.lit(False)).alias("burn_fast"),
        rollback.alias("rollback_required"), F.concat_ws(",", F.coalesce(reason_arr, F.array().cast("array<string>"))).alias("rollback_reasons"),
        F.concat_ws(",", signals).alias("non_rollback_signals"),
    )


@register("model_roundtrip")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the baseline pipeline on the train split, save it to the shared scratch folder, load it back
    and score the test split with both; exact AUCs and the largest score difference."""
    from pyspark.ml import PipelineModel

    from driftwise.catalog.models import KEY, LABEL, _splits, prep_stages

    s = _splits(spark, sf_dir)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    model = md.fit_pipeline(train, prep_stages(), md.baseline_estimator())
    path = fs.scratch_path(spark, "model")
    fs.save_model(model, path)
    loaded = PipelineModel.load(path)
    a = md.positive_proba(model, test, [KEY, LABEL]).select(KEY, LABEL, F.col("proba").alias("p1"))
    b = md.positive_proba(loaded, test, [KEY]).select(KEY, F.col("proba").alias("p2"))
    scored = fs.scratch_path(spark, "scored")
    a.join(b, KEY).write.parquet(scored)  # scored once, read by every figure
    j = spark.read.parquet(scored)
    auc1 = roc_auc(j, "p1", LABEL).first()[0]
    auc2 = roc_auc(j, "p2", LABEL).first()[0]
    diff = j.agg(F.max(F.abs(F.col("p1") - F.col("p2")))).first()[0]
    return spark.createDataFrame([(pround(auc1), pround(auc2), float(diff or 0.0), j.count())],
                                 "auc_fitted double, auc_loaded double, max_abs_diff double, n_scored long")


@register(
    "seed_chunks",
    f"""WITH {INGEST_CTES}
SELECT category, CAST(count_if(category = 'en') AS BIGINT) AS n_before, CAST(count_if(category <> 'en') AS BIGINT) AS n_appended,
       count(*) AS n_after FROM chunks GROUP BY category""",
)
def seed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed the knowledge store — chunks already stored (the English documents, written first) are
    skipped by a left-anti join on chunk id, the rest appended; per category before / appended / after counts."""
    staged = fs.scratch_path(spark, "chunk-batch")
    _chunks(spark, sf_dir).write.mode("overwrite").parquet(staged)  # the incoming batch, chunked once
    chunks = spark.read.parquet(staged)
    path = fs.scratch_path(spark, "chunk-store")
    chunks.where(F.col("category") == "en").write.mode("overwrite").parquet(path)
    store = spark.read.parquet(path)
    before = store.groupBy("category").agg(F.count(F.lit(1)).alias("n_before"))
    new = chunks.join(store.select("chunk_id"), "chunk_id", "left_anti")
    new.write.mode("append").parquet(path)
    after = spark.read.parquet(path).where("is_active")
    appended = new.groupBy("category").agg(F.count(F.lit(1)).alias("n_appended"))
    total = after.groupBy("category").agg(F.count(F.lit(1)).alias("n_after"))
    return total.join(before, "category", "left").join(appended, "category", "left").select(
        "category", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_appended", F.lit(0)).alias("n_appended"), "n_after"
    )
