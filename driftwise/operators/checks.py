"""Declarative data contracts compiled to one aggregation.

A ``Check`` is (column, name, violation) where ``violation`` maps the column to
a boolean Column that is TRUE on a failing row.  A ``Contract`` adds presence,
type-class and nullability rules.  ``violation_counts`` evaluates every rule of
a contract in a *single* ``agg`` (one scan, map-side partial counts), and
``split_by_contract`` tags rows with the array of failed rule ids so good rows
and quarantined rows can be written from the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.scalar import to_double

Violation = Callable[[Column], Column]


@dataclass(frozen=True)
class Check:
    column: str
    name: str
    violation: Violation

    def rule_id(self) -> str:
        return f"{self.column}:{self.name}"


def isin(values: Sequence) -> Violation:
    return lambda c: ~c.isin(list(values))


def in_range(lo: float | None = None, hi: float | None = None) -> Violation:
    def v(c: Column) -> Column:
        x = to_double(c)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (x < F.lit(float(lo)))
        if hi is not None:
            bad = bad | (x > F.lit(float(hi)))
        return bad

    return v


def ge(lo: float) -> Violation:
    return in_range(lo, None)


def matches(pattern: str) -> Violation:
    return lambda c: ~c.cast("string").rlike(pattern)


def length_between(lo: int, hi: int) -> Violation:
    return lambda c: (F.length(c.cast("string")) < lo) | (F.length(c.cast("string")) > hi)


def label_in(values: Sequence[str]) -> Violation:
    """X1-style custom check: lower/strip string form must be in ``values``."""
    return lambda c: ~F.lower(F.trim(c.cast("string"))).isin(list(values))


def non_numeric() -> Violation:
    """Non-null value that fails numeric parsing (or NULL after parsing)."""
    return lambda c: to_double(c.cast("string")).isNull()


@dataclass(frozen=True)
class ColumnRule:
    column: str
    kind: str | None = None  # "int" | "float" | "str" | None (any)
    nullable: bool = True
    checks: tuple[tuple[str, Violation], ...] = ()


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[ColumnRule, ...]
    strict: bool = False
    extra: tuple[Check, ...] = field(default=())


def _kind_ok(dtype: T.DataType, kind: str | None) -> bool:
    if kind is None:
        return True
    if kind == "int":
        return isinstance(dtype, (T.IntegralType, T.BooleanType))
    if kind == "float":
        # Spark ints are nullable, so an int column is accepted where a float is declared
        return isinstance(dtype, (T.NumericType, T.BooleanType))
    if kind == "str":
        return isinstance(dtype, T.StringType)
    raise ValueError(kind)


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """(column_name, check_name, n_failed) for every rule of the contract, one scan.

    Schema-level failures (missing column, wrong type class, unexpected column in
    strict mode) count as one failure case each, as a schema validator reports them.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema_rows: list[tuple[str, str, int]] = []
    aggs: list[Column] = []
    names: list[tuple[str, str]] = []
    for rule in contract.columns:
        if rule.column not in fields:
            schema_rows.append((rule.column, "column_present", 1))
            continue
        if not _kind_ok(fields[rule.column], rule.kind):
            schema_rows.append((rule.column, f"dtype_{rule.kind}", 1))
        c = F.col(rule.column)
        if not rule.nullable:
            names.append((rule.column, "not_null"))
            aggs.append(F.count_if(c.isNull()))
        for check_name, viol in rule.checks:
            names.append((rule.column, check_name))
            aggs.append(F.count_if(F.coalesce(c.isNotNull() & viol(c), F.lit(False))))
    for chk in contract.extra:
        names.append((chk.column, chk.name))
        aggs.append(F.count_if(F.coalesce(chk.violation(F.col(chk.column)), F.lit(False))))
    if contract.strict:
        declared = {r.column for r in contract.columns}
        schema_rows.extend((c, "unexpected_column", 1) for c in df.columns if c not in declared)
    spark = df.sparkSession
    schema = "column_name string, check_name string, n_failed long"
    parts = []
    if aggs:
        wide = df.agg(*[a.alias(f"_v{i}") for i, a in enumerate(aggs)])
        stack = "stack({}, {}) AS (column_name, check_name, n_failed)".format(
            len(names), ", ".join(f"'{col}', '{chk}', CAST(_v{i} AS BIGINT)" for i, (col, chk) in enumerate(names))
        )
        parts.append(wide.selectExpr(stack))
    if schema_rows:
        parts.append(spark.createDataFrame(schema_rows, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failed_rules(df: DataFrame, contract: Contract, out_col: str = "failed_rules") -> DataFrame:
    """Adds ``failed_rules array<string>`` (rule ids) per row; empty array = clean row."""
    present = set(df.columns)
    tags = []
    for rule in contract.columns:
        if rule.column not in present:
            continue
        c = F.col(rule.column)
        if not rule.nullable:
            tags.append(F.when(c.isNull(), F.lit(f"{rule.column}:not_null")))
        for check_name, viol in rule.checks:
            tags.append(F.when(F.coalesce(c.isNotNull() & viol(c), F.lit(False)), F.lit(f"{rule.column}:{check_name}")))
    for chk in contract.extra:
        tags.append(F.when(F.coalesce(chk.violation(F.col(chk.column)), F.lit(False)), F.lit(chk.rule_id())))
    if not tags:
        return df.withColumn(out_col, F.array().cast("array<string>"))
    return df.withColumn(out_col, F.array_compact(F.array(*tags)))


def split_by_contract(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their failed rule ids) from one tagging pass."""
    tagged = failed_rules(df, contract)
    good = tagged.where(F.size("failed_rules") == 0).drop("failed_rules")
    bad = tagged.where(F.size("failed_rules") > 0)
    return good, bad


# The raw booking contract (ranges, enums, label domain) of the reference.
HOTELS = ("Resort Hotel", "City Hotel")
LABELS = ("0", "1", "yes", "no")


def raw_booking_contract(target_col: str = "is_canceled") -> Contract:
    r = ColumnRule
    return Contract(
        "raw_bookings",
        (
            r("hotel", "str", False, (("isin", isin(HOTELS)),)),
            r("arrival_date_year", "int", False, (("in_range", in_range(2010, 2030)),)),
            r("arrival_date_month", "str", False),
            r("arrival_date_week_number", "int", True, (("in_range", in_range(1, 53)),)),
            r("arrival_date_day_of_month", "int", True, (("in_range", in_range(1, 31)),)),
            r("stays_in_weekend_nights", "int", True, (("ge", ge(0)),)),
            r("stays_in_week_nights", "int", True, (("ge", ge(0)),)),
            r("adults", "int", True, (("ge", ge(0)),)),
            r("children", "float", True, (("ge", ge(0)),)),
            r("babies", "int", True, (("ge", ge(0)),)),
            r("lead_time", "int", False, (("ge", ge(0)),)),
            r("is_repeated_guest", "int", True, (("isin", isin([0, 1])),)),
            r("previous_cancellations", "int", True, (("ge", ge(0)),)),
            r("previous_bookings_not_canceled", "int", True, (("ge", ge(0)),)),
            r("booking_changes", "int", True, (("ge", ge(0)),)),
            r("adr", "float", True),
            r(target_col, None, False, (("label_domain", label_in(LABELS)),)),
        ),
    )


def processed_contract(target_col: str, numeric_cols: Sequence[str], categorical_cols: Sequence[str]) -> Contract:
    """V2: target int 0/1 not null; numeric columns fully numeric (NULL counts as a failure)."""
    r = ColumnRule
    cols = [r(target_col, "int", False, (("isin", isin([0, 1])),))]
    extra = tuple(Check(c, "numeric", lambda col: to_double(col.cast("string")).isNull()) for c in numeric_cols)
    cols += [r(c, None, True) for c in categorical_cols]
    return Contract("processed", tuple(cols), extra=extra)


# Guest record field constraints of the reference (ranges and enums).
GUEST_RANGES = {
    "lead_time": (0, 3650),
    "adults": (1, 20),
    "children": (0, 20),
    "babies": (0, 10),
    "stays_in_week_nights": (0, 365),
    "stays_in_weekend_nights": (0, 365),
    "previous_cancellations": (0, 100),
    "adr": (0, 100000),
}
DEPOSIT_TYPES = ("No Deposit", "Non Refund", "Refundable")
MARKET_SEGMENTS = ("Online TA", "Offline TA/TO", "Direct", "Corporate", "Groups")
PHONE_PATTERN = r"^\+?[0-9\- ]+$"
ISO3_PATTERN = r"^[A-Z]{3}$"


def guest_record_contract(columns: Sequence[str]) -> Contract:
    """The guest field constraints that apply to the columns present (NULL = not given)."""
    present = set(columns)
    rules = []
    for c, (lo, hi) in GUEST_RANGES.items():
        if c in present:
            rules.append(ColumnRule(c, None, True, (("range", in_range(lo, hi)),)))
    if "hotel" in present:
        rules.append(ColumnRule("hotel", None, True, (("enum", isin(HOTELS)),)))
    if "deposit_type" in present:
        rules.append(ColumnRule("deposit_type", None, True, (("enum", isin(DEPOSIT_TYPES)),)))
    if "phone" in present:
        rules.append(ColumnRule("phone", None, True, (("pattern", matches(PHONE_PATTERN)), ("length", length_between(7, 20)))))
    if "nationality" in present:
        rules.append(ColumnRule("nationality", None, True, (("pattern", matches(ISO3_PATTERN)),)))
    for c in ("first_name", "last_name"):
        if c in present:
            rules.append(ColumnRule(c, None, True, (("length", length_between(1, 100)),)))
    return Contract("guest_record", tuple(rules))
