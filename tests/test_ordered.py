"""Order-dependent columns over ranges equal the plain window, also for a hot key and a burst."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from telespark.functions.ordered import previous, row_position, running_total


def rows(spark):
    rnd = random.Random(7)
    data = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}", rnd.randrange(5000), i, rnd.randrange(100)) for i in range(3000)]
    data += [(None, 17, 9001, 5), (None, 4100, 9002, 6)]
    return spark.createDataFrame(data, "k string, ts long, id long, v long")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_running_total_and_position(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    got = running_total(df, ["k"], ["ts", "id"], F.col("v"), "total").select("id", "total")
    same(got, df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total")))
    got = row_position(df, ["k"], ["ts", "id"], "pos").select("id", "pos")
    same(got, df.select("id", F.row_number().over(w).alias("pos")))


def test_previous(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    got = previous(df, ["k"], ["ts", "id"], ["v", "ts"]).select("id", "prev_v", "prev_ts")
    same(got, df.select("id", F.lag("v").over(w), F.lag("ts").over(w)))


def test_a_burst_splits_and_the_input_is_read_once(spark):
    n = 40_000
    burst = spark.range(n).select(F.when(F.col("id") % 50 == 0, None).otherwise("hot").alias("k"), F.lit(1_700_000_000).alias("second"), F.col("id").alias("tick"), (F.col("id") % 7).alias("v"))
    got = row_position(burst, ["k"], ["second", "tick"], "pos")
    assert got.where("k = 'hot'").agg(F.count_distinct("pos"), F.max("pos"), F.min("pos")).first()[:] == (n - n // 50, n - n // 50, 1)
    assert got.where("k is null and pos = 1 + tick div 50").count() == n // 50
    files = [r.n for r in got.where("k = 'hot'").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert len(files) == 4 and max(files) < n / 2                       # one group, all ranges
    before = previous(burst, ["k"], ["second", "tick"], ["tick", "v"])
    assert before.where("k = 'hot' and prev_tick < tick and prev_v = prev_tick % 7").count() == n - n // 50 - 1


def test_ranges_of_one_group_each_carry_on(spark):
    rows = [(k, i, 1) for k, many in (("a", 1), ("b", 900), ("c", 3), ("d", 800)) for i in range(many)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    w = Window.partitionBy("k").orderBy("id")
    same(row_position(df, ["k"], ["id"], "pos").select("k", "id", "pos"), df.select("k", "id", F.row_number().over(w)))
    same(previous(df, ["k"], ["id"], ["id", "k"]).select("k", "id", "prev_id", "prev_k"), df.select("k", "id", F.lag("id").over(w), F.lag("k").over(w)))
    assert row_position(df.limit(0), ["k"], ["id"], "pos").count() == 0
