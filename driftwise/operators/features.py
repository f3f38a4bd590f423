"""Preprocessing and feature engineering.

Fill values (medians, modes), frequency tables and category indexes are
*fitted* with aggregations and applied as expressions or joins; nothing is
collected beyond O(columns) numbers, except category labels for the one-hot
encoder (Spark ML keeps those in the model, like any ``StringIndexerModel``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.scalar import map_lookup, month_cos, month_number, month_sin
from driftwise.plans.ordering import exact_quantiles_many

# Frequency tables above this many categories are joined with a shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 1_000_000


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric test as the reference's dtype kinds b,i,u,f,c (bool counts as numeric)."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def all_features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


def infer_feature_spec(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> FeatureSpec:
    """Split columns into numeric / categorical from the schema."""
    skip = {target, *exclude}
    num = tuple(f.name for f in df.schema.fields if f.name not in skip and is_numeric(f.dataType))
    cat = tuple(f.name for f in df.schema.fields if f.name not in skip and not is_numeric(f.dataType))
    return FeatureSpec(num, cat)


def strip_columns(df: DataFrame) -> DataFrame:
    """P1."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop blocked / leakage columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns whose every value is NULL (one aggregation)."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    empty = [c for i, c in enumerate(df.columns) if row[f"c{i}"] == 0]
    return df.drop(*empty)


def normalise_labels(df: DataFrame, target: str, label_map: Mapping[str, int]) -> DataFrame:
    """lower/strip, map; any unknown label is an error listing the offenders (left-anti)."""
    norm = F.lower(F.trim(F.col(target).cast("string")))
    known = df.sparkSession.createDataFrame([(k,) for k in label_map], "label string")
    unknown = df.select(norm.alias("label")).distinct().join(F.broadcast(known), "label", "left_anti")
    bad = [r["label"] for r in unknown.limit(50).collect()]
    if bad:
        raise ValueError(f"Unknown target labels: {sorted(map(str, bad))} | label_map keys={sorted(label_map)}")
    return df.withColumn(target, map_lookup(label_map, norm).cast("long"))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, lowest value on ties.

    Long form → grouped counts (partial aggregation) → ``min_by`` over
    (−count, value) per column: two-phase aggregation, no single buffer of
    every distinct value.
    """
    if not cols:
        return {}
    casts = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {casts}) AS (column_name, value)").where("value IS NOT NULL")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))).alias("mode")
    )
    found = {r["column_name"]: r["mode"] for r in best.collect()}
    return {c: found.get(c) for c in cols}


def fit_imputer(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, object]:
    """Exact median for numeric columns, mode for the others; all-NULL categorical → 'UNKNOWN'."""
    parsed = df.select(*[F.col(c).cast("double").alias(c) for c in numeric])
    med = exact_quantiles_many(parsed, list(numeric), [0.5]) if numeric else {}
    fills: dict[str, object] = {c: med[c][0] for c in numeric}
    for c, m in modes(df, categorical).items():
        fills[c] = m if m is not None else "UNKNOWN"
    return fills


def apply_fills(df: DataFrame, fills: Mapping[str, object], numeric: Sequence[str]) -> DataFrame:
    """Fill NULL (and NaN) with the fitted values; filled numeric columns become DOUBLE."""
    dtypes = dict(df.dtypes)
    out = df
    for c, v in fills.items():
        if c in numeric:
            if v is None:
                continue
            x = F.col(c).cast("double")
            if dtypes[c] in ("double", "float"):
                x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
            out = out.withColumn(c, F.coalesce(x, F.lit(float(v))))
        else:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(v)))
    return out


def preprocess_basic(
    df: DataFrame,
    target: str,
    label_map: Mapping[str, int],
    drop_cols: Sequence[str] = (),
    blocked: Sequence[str] = (),
) -> DataFrame:
    """P1 → P2 → P4 → P3 → impute (median / mode) → V9 gate (no NULL left)."""
    out = strip_columns(df)
    out = drop_present(out, [*drop_cols, *blocked])
    out = normalise_labels(out, target, label_map)
    # one pass: non-null counts give both the all-NULL columns (P3) and the columns that need a fill
    cols = out.columns
    row = out.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)], F.count(F.lit(1)).alias("_n")).first()
    non_null = {c: row[f"c{i}"] for i, c in enumerate(cols)}
    out = out.drop(*[c for c in cols if non_null[c] == 0])
    features = [c for c in out.columns if c != target]
    dtypes = {f.name: f.dataType for f in out.schema.fields}
    numeric = [c for c in features if is_numeric(dtypes[c])]
    categorical = [c for c in features if c not in numeric]
    with_nulls_num = [c for c in numeric if non_null[c] < row["_n"]]
    with_nulls_cat = [c for c in categorical if non_null[c] < row["_n"]]
    fills = fit_imputer(out, with_nulls_num, with_nulls_cat)
    # V9 gate: every column that holds NULLs has a fill value, and fills are applied with coalesce
    missing = [c for c in with_nulls_num if fills.get(c) is None]
    if missing:
        raise ValueError(f"imputation left NULLs in {missing}")
    return apply_fills(out, fills, with_nulls_num)


class FrequencyEncoder:
    """Fit category → share on a training frame; transform maps unseen categories to 0.0."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> FrequencyEncoderModel:
        n = df.count()
        casts = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in self.cols)
        long = df.selectExpr(f"stack({len(self.cols)}, {casts}) AS (column_name, value)")
        # pandas astype(str) turns missing values into a category of their own
        long = long.withColumn("value", F.coalesce("value", F.lit("nan")))
        table = long.groupBy("column_name", "value").agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias("freq"))
        return FrequencyEncoderModel(self.cols, table)


class FrequencyEncoderModel:
    def __init__(self, cols: Sequence[str], table: DataFrame):
        self.cols = list(cols)
        self.table = table.cache()
        self._rows = self.table.count()

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Replace each column by its fitted share (or add ``<col><suffix>`` when a suffix is given)."""
        out = df
        for c in self.cols:
            t = self.table.where(F.col("column_name") == c).select(F.col("value").alias(f"_fv_{c}"), F.col("freq").alias(f"_ff_{c}"))
            if self._rows <= BROADCAST_MAX_ROWS:  # size checked at fit time
                t = F.broadcast(t)
            key = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
            out = out.join(t, key == F.col(f"_fv_{c}"), "left").withColumn(
                f"{c}{suffix}", F.coalesce(F.col(f"_ff_{c}"), F.lit(0.0))
            )
            out = out.drop(f"_fv_{c}", f"_ff_{c}")
        return out

    def feature_names_out(self, input_cols: Sequence[str], month_col: str | None = None) -> list[str]:
        """E5: output names after the feature engineer (month → _sin/_cos appended)."""
        cols = list(input_cols)
        if month_col and month_col in cols:
            cols.remove(month_col)
            cols += [f"{month_col}_sin", f"{month_col}_cos"]
        return cols


def cyclic_month(df: DataFrame, col: str) -> DataFrame:
    """Month → <col>_sin, <col>_cos, source column dropped."""
    m = month_number(F.col(col))
    return df.withColumn(f"{col}_sin", month_sin(m)).withColumn(f"{col}_cos", month_cos(m)).drop(col)


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median-impute then (x − mean) / σ_pop (population σ, as the reference's scaler)."""
    fills = fit_imputer(df, cols, [])
    filled = apply_fills(df, fills, cols)
    row = filled.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]).first()
    out = filled
    for c in cols:
        s = row[f"{c}__s"]
        scale = s if s not in (None, 0.0) else 1.0
        out = out.withColumn(f"{c}_z", (F.col(c) - F.lit(row[f"{c}__m"])) / F.lit(scale))
    return out


def one_hot_fit_apply(fit_df: DataFrame, apply_df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Most-frequent impute → StringIndexer(keep) → OneHotEncoder(dropLast): unknown → all zeros.

    Returns the encoded ``apply_df`` (one vector column ``<c>_ohe`` per input)
    and the category labels per column (slot order).
    """
    fills = {c: m if m is not None else "UNKNOWN" for c, m in modes(fit_df, cols).items()}
    fit_f = apply_fills(fit_df.select(*[F.col(c).cast("string").alias(c) for c in cols]), fills, [])
    app_f = apply_fills(apply_df.withColumns({c: F.col(c).cast("string") for c in cols}), fills, [])
    idx = StringIndexer(
        inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep", stringOrderType="frequencyDesc"
    ).fit(fit_f)
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols], dropLast=True).fit(
        idx.transform(fit_f)
    )
    encoded = enc.transform(idx.transform(app_f))
    labels = {c: list(lab) for c, lab in zip(cols, idx.labelsArray)}
    return encoded, labels


def one_hot_slot_counts(encoded: DataFrame, labels: Mapping[str, list[str]]) -> DataFrame:
    """Ones per one-hot slot plus the all-zero (unknown) rows, per column."""
    parts = []
    spark = encoded.sparkSession
    for c, labs in labels.items():
        arr = vector_to_array(F.col(f"{c}_ohe"))
        per_row = encoded.select(F.array_position(arr, 1.0).alias("slot"))  # 1-based, 0 = all zeros
        counts = per_row.groupBy("slot").agg(F.count(F.lit(1)).alias("n_ones"))
        lab_df = spark.createDataFrame([(i + 1, lab) for i, lab in enumerate(labs)] + [(0, "__unknown__")], "slot int, category string")
        parts.append(
            lab_df.join(counts, "slot", "left").select(
                F.lit(c).alias("column_name"), "category", F.coalesce("n_ones", F.lit(0)).cast("long").alias("n_ones")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arrival_features(df: DataFrame, as_of: str, lead_time: str) -> DataFrame:
    """arrival = as_of + lead_time days → year, month name, ISO week, day of month."""
    arrival = F.date_add(F.col(as_of).cast("date"), F.coalesce(F.col(lead_time), F.lit(0)).cast("int"))
    return df.select(
        "*",
        F.date_format(arrival, "yyyy-MM-dd").alias("arrival_date"),
        F.year(arrival).alias("arrival_year"),
        F.date_format(arrival, "MMMM").alias("arrival_month"),
        F.weekofyear(arrival).alias("arrival_week"),
        F.dayofmonth(arrival).alias("arrival_day"),
    )
