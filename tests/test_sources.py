import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.operators import logs as L
from telespark.plans import views
from telespark.sources import export as X
from telespark.sources import schema as S

SF = "/root/testdata/sf0.001"


def test_kinds():
    cases = {"string": T.StringType(), "int": T.LongType(), "float": T.DecimalType(20, 8), "datetime": T.DateType(), "json": T.VariantType(),
             "map": T.MapType(T.StringType(), T.StringType()), "array": T.ArrayType(T.LongType()), "other": T.BinaryType()}
    assert {k: S.column_kind(v) for k, v in cases.items()} == {k: k for k in cases}


def test_load_and_dimensions(spark, tmp_path):
    path = str(tmp_path / "logs")
    views.app_log(spark, SF).write.parquet(path)
    df = S.load_logs(spark, path)
    assert S.dimensions(df, S.LOG_COLUMNS) == ["service_name", "namespace", "pod", "cluster"]
    with pytest.raises(S.SchemaError, match="pod"):
        S.check_dimension(df, S.LOG_COLUMNS, "message")
    with pytest.raises(S.SchemaError, match="message, host"):
        S.as_logs(df.drop("host", "message"))
    S.as_spans(views.spans(spark, SF))
    with pytest.raises(S.SchemaError, match="span_attributes"):
        S.as_spans(views.spans(spark, SF).withColumn("span_attributes", F.lit("x")))


def test_optional_tables(spark):
    assert S.as_metrics(views.otel_metric(spark, SF)).df is not None
    bad = S.as_metrics(views.otel_metric(spark, SF).drop("flags"))
    assert bad.df is None and "flags" in bad.reason
    assert "no_such_table" in S.load_metrics(spark, "no_such_table").reason


def test_bill_tables(spark):
    views.volcengine_bill(spark, SF).createOrReplaceTempView("volcengine_bill_details")
    views.alicloud_bill(spark, SF).createOrReplaceTempView("alicloud_bill_daily_distributed")
    views.alicloud_bill(spark, SF).drop("currency").createOrReplaceTempView("alicloud_bill_monthly")
    try:
        t = S.load_bills(spark, declared={"alicloud_daily": "billing_date, line_id", "volcengine": "toDate(x)"})
        assert set(t.tables) == {"volcengine", "alicloud_daily"} and t.notes[1:] == ["alicloud_bill_monthly lacks columns: currency"]
        assert t.tables["alicloud_daily"].keys == ["billing_date", "line_id"]
        # a part of the fixed key would take different lines for repeated ones
        assert t.tables["volcengine"].keys == [] and "BillDetailId" in t.notes[0]
    finally:
        for n in ("volcengine_bill_details", "alicloud_bill_daily_distributed", "alicloud_bill_monthly"):
            spark.catalog.dropTempView(n)


def test_csv_is_formula_safe(spark, tmp_path):
    cells = ['=HYPERLINK("http://x/")', "+1", "@SUM(A1)", "-cmd", "\tx", "a=1", "", '"=q"', "中文=1", "a\n=b"]
    df = spark.createDataFrame([(i, c, -12.5) for i, c in enumerate(cells)], "i int, c string, n double").coalesce(1)
    X.write_rows(df, str(tmp_path / "out"))
    (part,) = glob.glob(os.path.join(tmp_path, "out", "part-*.csv"))
    with open(part, newline="") as fh:
        got = {int(r["i"]): (r["c"], r["n"]) for r in csv.DictReader(fh)}
    assert [got[i][1] for i in range(len(cells))] == ["-12.5"] * len(cells)
    assert [got[i][0].strip() for i in range(4)] == ["'" + c for c in cells[:4]] and got[5][0] == "a=1" and got[7][0] == '"=q"' and got[8][0] == "中文=1"


def test_jsonl(spark, tmp_path):
    X.write_rows(spark.createDataFrame([(1, "=x")], "i int, c string"), str(tmp_path / "out"), "jsonl")
    (part,) = [p for p in glob.glob(os.path.join(tmp_path, "out", "part-*.json")) if os.path.getsize(p)]
    with open(part) as fh:
        assert json.loads(fh.read()) == {"i": 1, "c": "=x"}
    with pytest.raises(ValueError):
        X.write_rows(spark.range(1), str(tmp_path / "o2"), "xlsx")


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    """Time bounds and equality are pushed down and only needed columns are read."""
    path = str(tmp_path / "logs")
    views.app_log(spark, SF).write.parquet(path)
    f = L.LogFilter(L.TimeRange(views.BASE, views.BASE + 3_600_000), host="host-1", levels=("ERROR",))
    L.log_histogram(S.load_logs(spark, path), f).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed and "EqualTo(host,host-1)" in pushed
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert read == "ReadSchema: struct<timestamp:timestamp,level:string,host:string>"
