"""Order-dependent columns over groups of any size.

A plain ``lag`` or running total puts a whole group into one task, and one key may hold a third of all rows. Here rows
are dealt out by ranges of (group, order) and sorted within them, so a group of any size, also one of a single second, is cut
into as many pieces as it needs. Each task goes through its rows once and writes them with what it can tell; only the group
that a range begins with can go on from the range before. So one row for each end of a range is looked at, and what is
carried into a range is joined to it. The input is read once; its rows go through one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.functions.lineage import written

PART, FIRST, EDGE = "__part", "__first", "__edge"       # range, whether of its first group, and whether its first (1) or last (2) row
KEY = "__k"


def _swept(df: DataFrame, keys: list[str], order: list[str], made: dict[str, T.DataType], sweep, need: list[str] = ()) -> tuple[DataFrame, list]:
    """``df`` in ranges, with the columns ``made`` by ``sweep(new, batch, held)`` and the range columns; and its edge rows, with ``need``.

    ``new`` marks rows whose group differs from the row before; ``held`` is a dict kept through a range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn(PART, F.spark_partition_id())
    names, at = ranged.columns, [ranged.columns.index(k) for k in keys]
    fields = [*ranged.schema.fields, *[T.StructField(c, t) for c, t in made.items()], T.StructField(FIRST, T.BooleanType()), T.StructField(EDGE, T.IntegerType())]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict = {}
        first, waiting = True, None

        def out(batch, columns, firsts, edges):
            return pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(firsts), pa.array(edges, pa.int32())], names=[*names, *made, FIRST, EDGE])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for i in at:
                column = batch.column(i)
                a, b = column.slice(1), column.slice(0, len(column) - 1)
                differ = pc.fill_null(pc.not_equal(a, b), True)
                differ = pc.and_not(differ, pc.and_(pc.is_null(a), pc.is_null(b)))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            now = tuple(batch.column(i)[0].as_py() for i in at)
            start = "key" not in held
            new[0] = start or now != held["key"]
            columns = sweep(new, batch, held)
            groups = new.copy()
            groups[0] &= not start
            firsts = (np.cumsum(groups) == 0) & first
            first = bool(firsts[-1])
            edges = np.zeros(batch.num_rows, dtype=np.int32)
            edges[0] = int(start)
            held["key"] = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in at)
            if waiting:
                yield out(*waiting)
            waiting = batch, columns, firsts, edges
        if waiting:
            waiting[3][-1] += 2
            yield out(*waiting)

    rows = spark.read.schema(T.StructType(fields)).parquet(written(ranged.mapInArrow(run, T.StructType(fields)), "ranges"))
    edges = rows.where(F.col(EDGE) > 0).select(PART, EDGE, F.struct(*[F.col(k).alias(f"{KEY}{i}") for i, k in enumerate(keys)]).alias(KEY), *made, *[F.col(c).alias(f"__{c}") for c in need])
    return rows, edges.collect()


def _carried(rows: DataFrame, edges: list, value: T.DataType, carry) -> DataFrame:
    """``rows`` with ``__carry``: what ``carry(last edge row before, what was carried into that range)`` gives for the first group of a range."""
    ends = {}
    for e in edges:
        first, last = ends.setdefault(e[PART], [None, None])
        ends[e[PART]] = [e if e[EDGE] & 1 else first, e if e[EDGE] & 2 else last]
    out, before, into = [], None, None
    for part in sorted(ends):
        first, last = ends[part]
        mine = carry(before, into) if before is not None and before[KEY] == first[KEY] else None
        if mine is not None:
            out.append((part, mine))
        into = mine if first[KEY] == last[KEY] else None
        before = last
    found = rows.sparkSession.createDataFrame(out, T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("__carry", value)]))
    return rows.join(F.broadcast(found), PART, "left")        # at most one row for each range


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Running sum of whole numbers per group up to and including each row."""
    def sweep(new, batch, held):
        import numpy as np
        import pyarrow as pa

        v = batch.column(at).to_numpy(zero_copy_only=False)
        total = np.cumsum(v)
        starts = np.flatnonzero(new)
        base = np.zeros(len(v), dtype=np.int64)
        base[starts] = np.diff(np.concatenate([[0], (total - v)[starts]]))
        inside = total - np.cumsum(base)
        if not new[0]:
            inside[: starts[0] if len(starts) else len(v)] += held["total"]
        held["total"] = int(inside[-1])
        return [pa.array(inside)]

    df = df.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    at = df.columns.index("__v")
    rows, edges = _swept(df, keys, order, {"__in": T.LongType()}, sweep)
    done = _carried(rows, edges, T.LongType(), lambda last, into: last["__in"] + (into or 0))
    total = F.col("__in") + F.when(F.col(FIRST), F.coalesce("__carry", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return done.withColumn(out, total).drop(PART, FIRST, EDGE, "__carry", "__in", "__v")


def row_position(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position of each row in its group."""
    return running_total(df, keys, order, F.lit(1), out)


def previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<col>``: the value in the row before."""
    def sweep(new, batch, held):
        import pyarrow as pa
        import pyarrow.compute as pc

        made = []
        for i in at:
            column = batch.column(i)
            shifted = pa.concat_arrays([pa.array([held.get(i)], column.type), column.slice(0, len(column) - 1)])
            made.append(pc.if_else(pa.array(new), pa.scalar(None, column.type), shifted))
            held[i] = column[len(column) - 1].as_py()
        return made

    at = [df.columns.index(c) for c in cols]
    kinds = {f"__prev_{c}": df.schema[c].dataType for c in cols}
    rows, edges = _swept(df, keys, order, kinds, sweep, [c for c in cols if c not in keys])
    value = T.StructType([T.StructField(c, df.schema[c].dataType) for c in cols])
    # keys are the same across the border, so a key column asked for is the row's own
    taken = lambda last, into: tuple(last[f"__{c}"] if c not in keys else last[KEY][keys.index(c)] for c in cols)
    done = _carried(rows, edges, value, taken)
    head = (F.col(EDGE) % 2 == 1) & F.col("__carry").isNotNull()
    return done.withColumns({prefix + c: F.when(head, F.col("__carry")[c]).otherwise(F.col(f"__prev_{c}")) for c in cols}) \
        .drop(PART, FIRST, EDGE, "__carry", *kinds)
