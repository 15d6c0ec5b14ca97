"""Span trees: depth, siblings, root cause and the root request's window.

Depth uses pointer jumping: every span knows an ancestor and the distance to it,
and each round replaces that ancestor by the ancestor's own.  A chain of length d
is done after log2(d) rounds, whatever the number of traces.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from telespark.functions.lineage import forget_at_exit, shared_folder, use_checkpoints, written
from telespark.functions.ordered import row_position
from telespark.operators.traces import is_error

LARGE = 1_000_000       # spans of a trace that one task holds


def _parents(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, parent``: parent is NULL where no other span has that id."""
    ids = spans.select("trace_id", F.col("span_id").alias("want"), F.lit(True).alias("found"))
    child = spans.select("trace_id", "span_id", F.when(
        (F.col("parent_span_id") != "") & (F.col("parent_span_id") != F.col("span_id")), F.col("parent_span_id")).alias("want"))
    linked = child.where("want is not null").join(ids, ["trace_id", "want"], "left").select(
        "trace_id", "span_id", F.when(F.col("found"), F.col("want")).alias("parent"))
    return linked.unionByName(child.where("want is null").select("trace_id", "span_id", F.col("want").alias("parent")))


def resolve_roots(edges: DataFrame) -> DataFrame:
    """``trace_id, span_id, parent, top, depth, cyclic`` from ``trace_id, span_id, parent``.

    Spans on or under a cycle never reach a root: they keep ``depth`` 0 and no top."""
    use_checkpoints(edges.sparkSession)
    state = edges.select("trace_id", "span_id", "parent", F.coalesce("parent", "span_id").alias("top"),
                         F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
                         F.col("parent").isNotNull().alias("pending")).checkpoint()
    done, pending = state.where("not pending"), state.where("pending")
    left = pending.count()
    while left:
        # resolved rows stay where they were written; a round writes the others only
        there = done.unionByName(pending).select("trace_id", F.col("span_id").alias("top"), F.col("top").alias("up"),
                                                 F.col("depth").alias("more"), F.col("pending").alias("far"))
        moved = (pending.join(there, ["trace_id", "top"])
                 .select("trace_id", "span_id", "parent", F.col("up").alias("top"),
                         (F.col("depth") + F.col("more")).alias("depth"), F.col("far").alias("pending"))).checkpoint()
        done, pending = done.unionByName(moved.where("not pending")), moved.where("pending")
        now = pending.count()
        if now == left:          # no progress: only cycles are left
            break
        left = now
    return done.unionByName(pending).select(
        "trace_id", "span_id", "parent", F.when(~F.col("pending"), F.col("top")).alias("top"),
        F.when(F.col("pending"), 0).otherwise(F.col("depth")).alias("depth"), F.col("pending").alias("cyclic"))


@contextmanager
def _by_trace(spark: SparkSession):
    """Joins by trace and span may stay within a trace's partition while plans are made here."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bucketed(df: DataFrame) -> DataFrame:
    """``df`` as a table in buckets of ``trace_id``, in the shared folder until the application ends."""
    spark = df.sparkSession
    name, path = f"telespark_{uuid.uuid4().hex}", f"{shared_folder(spark).rstrip('/')}/traces-{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "trace_id").option("path", path).saveAsTable(name)
    forget_at_exit(spark, path)
    table = spark.table(name)
    table.schema                        # resolved before its name goes; the files stay
    spark.sql(f"drop table {name}")
    return table


def _shape_within(slim: DataFrame) -> DataFrame:
    """``trace_id, span_id, parent, depth, cyclic, is_root, orphan, root_missing, pos_in_set, set_size`` of traces that fit a task.

    Ids are written once in buckets of the trace; the search for parents, every round of pointer jumping and the
    figures of siblings stay within a bucket. Traces that are resolved are left where they are."""
    spark = slim.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _by_trace(spark):
        ids = _bucketed(slim.repartition(n, "trace_id"))
        want = F.when((F.col("parent_span_id") != "") & (F.col("parent_span_id") != F.col("span_id")), F.col("parent_span_id"))
        there = ids.select("trace_id", F.col("span_id").alias("want"), F.lit(True).alias("found"))
        linked = ids.withColumn("want", want).join(there, ["trace_id", "want"], "left").withColumn("parent", F.when(F.col("found"), F.col("want")))
        state = linked.select("trace_id", "span_id", "parent_span_id", "timestamp", "parent", F.coalesce("parent", "span_id").alias("top"),
                              F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("parent").isNotNull().alias("pending"))
        live = F.max("pending").over(Window.partitionBy("trace_id"))
        parts, left = [], None
        while True:
            seen = Observation()
            state = _bucketed(state.withColumn("live", live).observe(seen, F.count_if("pending").alias("pending")))
            now = seen.get["pending"]
            done = now == 0 or now == left              # no progress: only cycles are left
            parts.append(state if done else state.where("not live"))
            if done:
                break
            left, state = now, state.where("live").drop("live")
            up = state.select("trace_id", F.col("span_id").alias("top"), F.col("top").alias("up"), F.col("depth").alias("more"), F.col("pending").alias("far"))
            state = state.join(up, ["trace_id", "top"]).select(
                "trace_id", "span_id", "parent_span_id", "timestamp", "parent", F.when(F.col("pending"), F.col("up")).otherwise(F.col("top")).alias("top"),
                F.when(F.col("pending"), F.col("depth") + F.col("more")).otherwise(F.col("depth")).alias("depth"), (F.col("pending") & F.col("far")).alias("pending"))
        siblings = Window.partitionBy("trace_id", F.coalesce("parent", F.lit("")))
        shaped = [part.select(
            "trace_id", "span_id", "parent", F.when(F.col("pending"), 0).otherwise(F.col("depth")).alias("depth"), F.col("pending").alias("cyclic"),
            F.col("parent").isNull().alias("is_root"), (F.col("parent").isNull() & (F.col("parent_span_id") != "")).alias("orphan"),
            F.row_number().over(siblings.orderBy("timestamp", "span_id")).cast("long").alias("pos_in_set"), F.count("*").over(siblings).alias("set_size"),
            (F.count_if(F.col("parent_span_id") == "").over(Window.partitionBy("trace_id")) == 0).alias("root_missing")) for part in parts]
    return reduce(DataFrame.unionByName, shaped)


def _shape_across(slim: DataFrame) -> DataFrame:
    """The same for traces of any size: rows are joined by (trace, span), siblings are counted off in ranges."""
    placed = resolve_roots(_parents(slim)).drop("top")
    flat = (slim.join(placed, ["trace_id", "span_id"])
            .withColumn("is_root", F.col("parent").isNull())
            .withColumn("orphan", F.col("parent").isNull() & (F.col("parent_span_id") != ""))
            .withColumn("sib", F.coalesce("parent", F.lit(""))))
    pos = row_position(flat, ["trace_id", "sib"], ["timestamp", "span_id"], "pos_in_set")
    sizes = placed.groupBy("trace_id", F.coalesce("parent", F.lit("")).alias("sib")).agg(F.count("*").alias("set_size"))
    no_root = slim.groupBy("trace_id").agg((F.count_if(F.col("parent_span_id") == "") == 0).alias("root_missing"))
    return pos.join(sizes, ["trace_id", "sib"]).join(no_root, "trace_id").drop("sib", "parent_span_id", "timestamp")


def span_tree(spans: DataFrame, large: int = LARGE) -> DataFrame:
    """Add ``depth, is_root, orphan, root_missing, pos_in_set, set_size`` to unique spans.

    The shape is worked out on ids and start times alone, which are written once, and joined to the spans at the end.
    Traces of up to ``large`` spans stay within a partition of their trace; larger ones, which one task should not
    hold, are worked out across partitions. Siblings are ordered by start."""
    use_checkpoints(spans.sparkSession)
    slim = spans.sparkSession.read.parquet(written(spans.select("trace_id", "span_id", "parent_span_id", "timestamp"), "span-ids"))
    big = slim.groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("trace_id")
    big = spans.sparkSession.read.schema(big.schema).parquet(written(big, "large-traces"))
    if big.isEmpty():
        shape = _shape_within(slim)
    else:
        shape = _shape_within(slim.join(big, "trace_id", "left_anti")).unionByName(_shape_across(slim.join(big, "trace_id", "left_semi")))
    return spans.join(shape, ["trace_id", "span_id"])


def keep_errors_and_slowest(spans: DataFrame, n: int) -> DataFrame:
    """At most ``n`` spans per trace, but never fewer than all failed ones: the failed
    spans plus the slowest others."""
    bad = spans.where(is_error())
    errors = bad.groupBy("trace_id").agg(F.count("*").alias("__errors"))
    w = Window.partitionBy("trace_id").orderBy(F.desc("duration_ns"), "timestamp", "span_id")
    rest = (spans.where(~is_error()).withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= n)
            .join(errors, "trace_id", "left")
            .where(F.col("__rk") + F.coalesce("__errors", F.lit(0)) <= n).drop("__rk", "__errors"))
    return bad.unionByName(rest)


def root_cause_span(tree: DataFrame) -> DataFrame:
    """Per trace the deepest failed span, the earliest of those equally deep."""
    order = F.struct((-F.col("depth")).alias("d"), F.col("timestamp"), F.col("span_id"))
    cols = [c for c in tree.columns if c != "trace_id"]
    return (tree.where(is_error()).groupBy("trace_id").agg(F.min_by(F.struct(*cols), order).alias("s"))
                .select("trace_id", "s.*"))


def root_window(spans: DataFrame) -> DataFrame:
    """``trace_id, start_us, end_us`` of the root request: the first root and the spans
    below it that start, through such spans all the way, before the root ends."""
    use_checkpoints(spans.sparkSession)
    slim = spans.select("trace_id", "span_id", "parent_span_id", F.unix_micros("timestamp").alias("us"), "duration_ns").checkpoint()
    flat = slim.drop("parent_span_id").join(_parents(slim), ["trace_id", "span_id"])
    main = (flat.where("parent is null").groupBy("trace_id")
            .agg(F.min(F.struct("us", "span_id", "duration_ns")).alias("r"))
            .select("trace_id", F.col("r.span_id").alias("root_id"), F.col("r.us").alias("root_us"),
                    (F.col("r.us") + F.col("r.duration_ns") / 1000).alias("root_end")))
    early = flat.join(main, "trace_id").where(F.col("us") <= F.col("root_end")).checkpoint()
    # cut late spans out of the forest; what still hangs on the root belongs to it
    kept = early.select("trace_id", "span_id", "parent")
    ids = kept.select("trace_id", F.col("span_id").alias("parent"), F.lit(True).alias("found"))
    linked = kept.join(ids, ["trace_id", "parent"], "left").select(
        "trace_id", "span_id", F.when(F.col("found"), F.col("parent")).alias("parent"))
    tops = resolve_roots(linked).select("trace_id", "span_id", "top")
    mine = early.join(tops, ["trace_id", "span_id"]).where(F.col("top") == F.col("root_id"))
    return mine.groupBy("trace_id").agg(
        F.min("root_us").alias("start_us"),
        F.greatest(F.max(F.col("us") + F.col("duration_ns") / 1000), F.min("root_us") + 1.0).alias("end_us"))
