"""Long-form (column, value) reshaping so one aggregation covers every column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_expr(cols: Sequence[str], value_type: str = "DOUBLE", name: str = "column_name", value: str = "value") -> str:
    casts = ", ".join(f"'{c}', try_cast(`{c}` AS {value_type})" for c in cols)
    return f"stack({len(cols)}, {casts}) AS ({name}, {value})"


def long_numeric(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), drop_null: bool = True) -> DataFrame:
    """(keep..., column_name, value double) with NaN → NULL; NULL rows dropped by default."""
    out = df.selectExpr(*[f"`{k}`" for k in keep], stack_expr(cols))
    out = out.withColumn("value", F.when(F.isnan("value"), F.lit(None).cast("double")).otherwise(F.col("value")))
    return out.where(F.col("value").isNotNull()) if drop_null else out


def long_strings(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), null_label: str | None = None) -> DataFrame:
    """(keep..., column_name, value string); NULL kept as ``null_label`` when given, else dropped."""
    casts = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    out = df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(cols)}, {casts}) AS (column_name, value)")
    if null_label is None:
        return out.where(F.col("value").isNotNull())
    return out.withColumn("value", F.coalesce(F.col("value"), F.lit(null_label)))

