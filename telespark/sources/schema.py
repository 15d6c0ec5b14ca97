"""Readers for the six tables, with the column checks every operator relies on.

``df.schema`` is the catalogue: columns outside the fixed set of a table are
extras, and its string extras are the dimensions a user may filter by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns each table always has.
LOG_COLUMNS = ("timestamp", "level", "trace_id", "span_id", "thread", "logger", "message", "file", "host")
SPAN_COLUMNS = (
    "timestamp", "trace_id", "span_id", "parent_span_id", "trace_state", "span_name", "span_kind",
    "service_name", "duration_ns", "status_code", "status_message", "scope_name", "scope_version",
    "resource_attributes", "span_attributes", "events", "links",
)
METRIC_COLUMNS = (
    "timestamp", "start_timestamp", "metric_name", "metric_type", "metric_unit", "metric_description",
    "service_name", "scope_name", "scope_version", "resource_attributes", "attributes", "value",
    "temporality", "is_monotonic", "count", "sum", "min", "max", "bucket_counts", "explicit_bounds",
    "quantiles", "exemplars", "flags",
)
VOLCENGINE_COLUMNS = (
    "BillPeriod", "ExpenseDate", "ExpenseBeginTime", "InstanceNo", "InstanceName", "Product", "ProductZh",
    "Element", "ElementCode", "Region", "RegionCode", "Zone", "ZoneCode", "OwnerID", "OwnerUserName",
    "OwnerCustomerName", "Project", "ProjectDisplayName", "BillingMode", "Currency", "Count", "Unit",
    "PayableAmount", "PaidAmount", "OriginalBillAmount",
)
ALICLOUD_COLUMNS = (
    "billing_cycle", "billing_date", "product_code", "product_name", "product_type", "product_detail",
    "instance_id", "instance_name", "bill_account_id", "bill_account_name", "subscription_type", "region",
    "zone", "resource_group", "cost_unit", "currency", "usage", "usage_unit", "pretax_amount",
    "payment_amount", "pretax_gross_amount",
)
# Columns that identify a billed line when a table declares no key.
DEDUPE_KEYS = {
    "volcengine": ("BillPeriod", "ExpenseDate", "InstanceNo", "ExpenseBeginTime", "Product", "ElementCode", "BillDetailId"),
    "alicloud_monthly": ("billing_cycle", "product_code", "instance_id", "bill_account_id", "subscription_type",
                         "billing_type", "item", "biz_type", "product_detail_code", "region", "zone", "split_item_id", "line_seq"),
    "alicloud_daily": ("billing_date", "product_code", "instance_id", "bill_account_id", "subscription_type",
                       "billing_type", "item", "biz_type", "product_detail_code", "region", "zone", "split_item_id", "line_seq"),
}
BILL_TABLES = {
    "volcengine": "volcengine_bill",
    "alicloud_monthly": "alicloud_bill_monthly",
    "alicloud_daily": "alicloud_bill_daily",
}
OLD_VOLCENGINE_TABLE = "volcengine_bill_details"
SHARDED_SUFFIX = "_distributed"


class SchemaError(ValueError):
    """A table cannot be used; the message names what is missing."""


def column_kind(dtype: T.DataType) -> str:
    """One of string, int, float, datetime, json, map, array, other."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, (T.VariantType, T.StructType)):
        return "json"
    if isinstance(dtype, T.MapType):
        return "map"
    return "array" if isinstance(dtype, T.ArrayType) else "other"


def missing_columns(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def _require(df: DataFrame, required, what: str) -> DataFrame:
    gaps = missing_columns(df, required)
    if gaps:
        raise SchemaError(f"the {what} table lacks columns: {', '.join(gaps)}")
    return df


def dimensions(df: DataFrame, fixed) -> list[str]:
    return [f.name for f in df.schema.fields if column_kind(f.dataType) == "string" and f.name not in fixed]


def check_dimension(df: DataFrame, fixed, name: str) -> str:
    allowed = dimensions(df, fixed)
    if name not in allowed:
        raise SchemaError(f"cannot filter by {name!r}; dimensions: {', '.join(allowed) or '(none)'}")
    return name


def _read(spark: SparkSession, source: str) -> DataFrame:
    """A path (``/`` or ``scheme://``) is Parquet; anything else is a catalogue table."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def _utc(df: DataFrame, *cols: str) -> DataFrame:
    """Zone-less timestamps are UTC instants, whatever zone the session is in."""
    ntz = [c for c in cols if c in df.columns and isinstance(df.schema[c].dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp") for c in ntz}) if ntz else df


def as_logs(df: DataFrame) -> DataFrame:
    return _utc(_require(df, LOG_COLUMNS, "log"), "timestamp")


def load_logs(spark: SparkSession, source: str) -> DataFrame:
    return as_logs(_read(spark, source))


def as_spans(df: DataFrame) -> DataFrame:
    _require(df, SPAN_COLUMNS, "span")
    for name in ("resource_attributes", "span_attributes"):
        if column_kind(df.schema[name].dataType) not in ("json", "map"):
            raise SchemaError(f"{name} must be VARIANT or MAP<STRING,STRING>, not {df.schema[name].dataType.simpleString()}")
    for name in ("events", "links"):
        dt = df.schema[name].dataType
        if not (isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType)):
            raise SchemaError(f"{name} must be an array of structs, not {dt.simpleString()}")
    return _utc(df, "timestamp")


def load_spans(spark: SparkSession, source: str) -> DataFrame:
    return as_spans(_read(spark, source))


@dataclass(frozen=True)
class Optional:
    """A table that may be unusable, with the reason why."""

    df: DataFrame | None
    reason: str = ""


def as_metrics(df: DataFrame) -> Optional:
    gaps = missing_columns(df, METRIC_COLUMNS)
    if gaps:
        return Optional(None, f"the metric table lacks columns: {', '.join(gaps)}")
    for name in ("resource_attributes", "attributes"):
        if column_kind(df.schema[name].dataType) not in ("json", "map"):
            return Optional(None, f"{name} must be VARIANT or MAP<STRING,STRING>")
    return Optional(_utc(df, "timestamp", "start_timestamp"))


def load_metrics(spark: SparkSession, source: str) -> Optional:
    if "/" not in source and not spark.catalog.tableExists(source):
        return Optional(None, f"table {source} does not exist")
    return as_metrics(_read(spark, source))


def declared_key(text: str) -> list[str] | None:
    """Columns of a declared sort key such as ``a, b, c``; None when it is empty
    or holds anything but plain column names."""
    cols = [c.strip() for c in text.split(",")]
    return cols if all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", c) for c in cols) else None


def dedupe_keys(df: DataFrame, kind: str, declared: str | None = None) -> list[str]:
    """De-dup key of a bill table: its declared key when usable, else the fixed one.

    A table without some of the fixed columns has no key: a part of it would take
    different lines for repeated ones."""
    cols = declared_key(declared) if declared else None
    if cols and not missing_columns(df, cols):
        return cols
    gaps = missing_columns(df, DEDUPE_KEYS[kind])
    if gaps:
        raise SchemaError(f"lines cannot be told apart without {', '.join(gaps)}; declare the table's key or read it with mode 'off'")
    return list(DEDUPE_KEYS[kind])


def bill_table_names(kind: str, configured: str | None = None) -> list[str]:
    """Names a bill table may go by, best first."""
    base = configured or BILL_TABLES[kind]
    names = [base, base + SHARDED_SUFFIX]
    if base == BILL_TABLES["volcengine"]:
        names += [OLD_VOLCENGINE_TABLE, OLD_VOLCENGINE_TABLE + SHARDED_SUFFIX]
    return names


@dataclass(frozen=True)
class BillTable:
    df: DataFrame
    keys: list[str]


@dataclass(frozen=True)
class BillTables:
    tables: dict[str, BillTable] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def load_bills(spark: SparkSession, configured: dict[str, str] | None = None,
               declared: dict[str, str] | None = None, database: str | None = None) -> BillTables:
    """The bill tables that exist and are complete; one bad table never hides the others."""
    tables, notes = {}, []
    for kind, required in (("volcengine", VOLCENGINE_COLUMNS), ("alicloud_monthly", ALICLOUD_COLUMNS),
                           ("alicloud_daily", ALICLOUD_COLUMNS)):
        names = bill_table_names(kind, (configured or {}).get(kind))
        names = [f"{database}.{n}" if database else n for n in names]
        found = next((n for n in names if spark.catalog.tableExists(n)), None)
        if found is None:
            notes.append(f"{names[0]} does not exist")
            continue
        df = spark.table(found)
        gaps = missing_columns(df, required)
        if gaps:
            notes.append(f"{found} lacks columns: {', '.join(gaps)}")
            continue
        try:
            keys = dedupe_keys(df, kind, (declared or {}).get(kind))
        except SchemaError as why:
            keys = []
            notes.append(f"{found}: {why}")
        tables[kind] = BillTable(df, keys)
    return BillTables(tables, notes)
