"""Operator 7: mixing sources to target weights by temperature, as budgeted block permutations.

With p the share of a source in all words, its weight is proportional to p**a: a = 1 keeps the shares,
a = 0 makes all sources equal. The exponent is bisected: the largest one whose weights reach the
target entropy (a fraction of the largest possible), raised where needed until no source is repeated
more often than the limit. The weights share out a budget of words. Documents are dealt into blocks
of about ``block_words`` words by a hash; for each epoch the blocks of a source get a new order, and a
source's budget takes whole epochs and then a prefix of the next order, to the nearest block.
``position`` (0 to 1) interleaves the sources evenly: sorted by it, any stretch has about the target weights.

Sources are never collected: each step of the bisection is an aggregate over the table of sources for
several exponents at once. Running sums over a source's blocks go through ``2**SLOT_BITS`` slots of
the order, so a source that holds most blocks is spread over many tasks.

Defined cases: rows without a source are a source of their own; a null or empty text has no words and
goes with its block; a source without words has no weight and is left out of a budget, but with budget None each of its
rows is there once at position 0; if even a = 1
repeats too often, the budget is cut to the limit; repeated rows are dealt to the same block; an empty
table gives an empty one; extra columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm import shared

BLOCK_WORDS = 8192
POINTS = 33             # exponents tried at once
STEPS = 6               # the bracket shrinks by 32 in each: 2**-30
SLOT_BITS = 10
BLOCKS = "source string, block long, epoch int, position double"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """60 bits of the md5 of the parts joined by '|': the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, entropy: float | None, repetition: float | None, budget: float | None) -> float:
    """The exponent for (source, words) rows, rounded to 6 places; ``budget`` as for ``plan``."""
    shares = shared.written(sources.where("words > 0").groupBy("words").agg(F.count("*").alias("n")), "shares")       # equal sources together
    totals = shares.agg(F.sum(F.col("words") * F.col("n")).alias("all"), F.sum("n").alias("n")).first()
    if not totals.n:
        return 1.0
    p = F.col("words") / F.lit(float(totals["all"]))

    def search(good) -> float:
        """The largest exponent up to which ``good`` holds, as it holds for all smaller ones."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            tried = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
            row = shares.agg(*[F.sum(F.col("n") * F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(tried)],
                             *[F.sum(F.col("n") * F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}") for i, a in enumerate(tried)], F.min(p).alias("least"), F.max(p).alias("most")).first()
            holds = [good(a, row[f"z{i}"], row[f"l{i}"], row) for i, a in enumerate(tried)]
            if all(holds):
                return tried[-1]
            first = holds.index(False)
            if first == 0:
                return tried[0]
            low, high = tried[first - 1], tried[first]
        return low

    found = 1.0
    if entropy is not None:
        wanted = entropy * math.log(totals.n)
        found = search(lambda a, z, l, row: math.log(z) - a * l / z >= wanted)
    if repetition is not None:
        # up to which exponent some source is repeated too often; it is the smallest one
        if budget is None:
            least = search(lambda a, z, l, row: (row.most / row.least) ** (1 - a) > repetition)
        else:
            least = search(lambda a, z, l, row: budget * row.least ** (a - 1) / z > repetition)
        found = least if entropy is None else max(found, least)
    return round(found, 6)


def plan(docs: DataFrame, entropy: float | None = 0.95, repetition: float | None = 4.0, budget: float | None = 1.0, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(blocks, rows): (source, block, epoch, position) for every block taken in an epoch, and (row, source, words, block) for every document.

    ``budget`` is in units of the corpus' words; None: the smallest with which no document is left out.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), F.col("doc_id").cast("string").alias("id"), n_words(F.col("text")).alias("words"))
    slim = rows.select("source", "id", "words")
    counted = shared.written(slim.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("rows")), "sources")
    total = counted.agg(F.sum("words")).first()[0] or 0
    # a source without words is dealt by its rows
    sized = counted.withColumn("blocks", F.ceil(F.when(F.col("words") > 0, F.col("words")).otherwise(F.col("rows")) / block_words).cast("long"))
    wordless = sized.where("words = 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1)).alias("block"), F.lit(0).alias("epoch"), F.lit(0.0).alias("position"))

    def dealt(df: DataFrame) -> DataFrame:
        # sources are joined null-safe: rows without one are a source too
        side = sized.select(F.col("source").alias("s"), F.greatest("blocks", F.lit(1)).alias("blocks"))
        return df.join(side, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(_hash(F.coalesce("source", F.lit("")), F.coalesce("id", F.lit(""))), F.col("blocks"))).drop("s", "blocks")

    if not total:
        return (wordless if budget is None else docs.sparkSession.createDataFrame([], BLOCKS)), dealt(rows)
    a = exponent(counted, entropy, repetition, budget)
    weight = F.pow(F.col("words") / F.lit(float(total)), F.lit(a))
    positive = counted.where("words > 0").withColumn("weight", weight)
    sums = positive.agg(F.sum("weight").alias("z"), F.max(F.col("words") / F.col("weight")).alias("most")).first()
    all_words = budget * total if budget is not None else sums.most * sums.z
    if repetition is not None and budget is not None:
        all_words = min(all_words, repetition * total)
    targets = positive.select("source", F.col("words").alias("of"), (F.col("weight") / F.lit(float(sums.z)) * F.lit(float(all_words))).alias("target"))
    targets = targets.withColumn("epochs", F.ceil(F.round(F.col("target") / F.col("of"), 6)).cast("int"))

    blocks = shared.written(dealt(slim).groupBy("source", "block").agg(F.sum("words").alias("words")), "blocks")
    t = targets.withColumnRenamed("source", "s")
    turns = blocks.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    turns = turns.withColumn("order", _hash(F.coalesce("source", F.lit("")), F.col("block"), F.col("epoch"))).withColumn("slot", F.shiftright("order", 60 - SLOT_BITS))
    turns = shared.written(turns, "turns")
    before = turns.groupBy("source", "epoch", "slot").agg(F.sum("words").alias("w"))
    before = before.withColumn("before", F.sum("w").over(Window.partitionBy("source", "epoch").orderBy("slot")) - F.col("w")) \
        .select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("slot").alias("t"), "before")
    inside = F.sum("words").over(Window.partitionBy("source", "epoch", "slot").orderBy("order", "block")) - F.col("words")
    placed = turns.withColumn("inside", inside).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("slot") == F.col("t")))
    start = F.col("epoch") * F.col("of") + F.col("before") + F.col("inside")
    taken = placed.withColumn("start", start).where((F.col("start") + F.col("words") / 2 <= F.round("target", 3)) | (F.col("epoch") + 1 <= F.col("target") / F.col("of") + 1e-9))
    taken = taken.select("source", "block", "epoch", (F.col("start") / F.col("target")).alias("position"))
    return (taken.unionByName(wordless) if budget is None else taken), dealt(rows)


def mix(docs: DataFrame, entropy: float | None = 0.95, repetition: float | None = 4.0, budget: float | None = 1.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, source, words, block, epoch, position): one row for each time a document is in the mixture."""
    blocks, rows = plan(docs, entropy, repetition, budget, block_words)
    b = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "position")
    return rows.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("row", "source", "words", "block", "epoch", "position")
