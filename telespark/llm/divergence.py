"""Operator 12: how far the sources of a language lie apart in their words.

The terms of a document are its runs of letters and of characters beyond ASCII, ASCII letters lower-cased. Each language keeps the terms of at least
``MIN_DOCS`` of its documents, with no limit to their number: a ``CountVectorizer`` with that minDF and the largest
vocabSize counts them and turns rows of terms into exact sparse vectors. A term is counted under its language, so one
fit serves all languages. Vectors are added up by (lang, source) as sparse sums, never as dense rows.

That class takes a String for each term of a row. So what it does to the documents is done to fewer rows that give the
same: it is fitted on rows that hold a term as often as there are documents with it, ``MIN_DOCS`` at most, which windows
of documents count and a Spark aggregate adds up; and vectors are linear, so those of the terms that occur n times in a
window's group are taken n times.

It also keeps its vocabulary in the driver and broadcasts it. So terms are dealt by hash into as many shards as hold
about ``SHARD`` at most of those in ``MIN_DOCS`` documents. Each shard is fitted on its own terms, written down once by
shard if there are several.

With p = 1 + floor(10^9 (count + 2) / (N + 2 V)) two groups differ by the sum of floor((p - q)^2 / (p + q)) over all
kept terms. Terms that neither group has, or only one, need no pair of rows: they differ by their counts alone, so they
are summed by (group, count). Only terms of both groups are met, inside the rows of one term, a bounded number at once.

Defined cases: null text, lang and source are ''; repeated rows are documents of their own; groups without terms count 0
everywhere, and where a language keeps no term all values are 0; equal values are ranked by name (UTF-8); an empty
table gives an empty result; only text, lang and source are read. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm import shared

#: What each byte of a text becomes: ASCII letters small ones, other ASCII characters blanks; the rest stays, whole words of it.
SIGNS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
ROWS = "lang string, source string, times long, terms array<string>"
MIN_DOCS = 10
WINDOW = 1 << 23        # bytes of consecutive documents (and 32 for each) whose terms are counted together, a longer one alone
BATCH = 1000            # documents that a Python worker gets at once
LONGEST = 512           # terms of a row at most
LARGEST = (1 << 31) - 1
SHARD = 1 << 19         # terms of a vocabulary at most
UNIT = 1_000_000_000
TOP = 10                # terms listed for a group
PAIRS = 1 << 20         # pairs of groups of a term compared at once


def _filled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of (lang, source, text) batches in windows of about ``most`` bytes, across batches."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
            if size and size + n + 32 > most:
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)]).combine_chunks().to_batches()[0]
                held, start, size = [], i, 0
            size += n + 32
        held.append(batch.slice(start))
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _window(lang: pa.Array, source: pa.Array, text: pa.Array, longest: int) -> Iterator[tuple]:
    """(groups' first rows, times, terms) of the documents of a window, as ``_windows`` returns them; ``text`` is large binary."""
    ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    if ends[0] == ends[-1]:
        return
    signs = np.frombuffer(text.buffers()[2][ends[0]:ends[-1]].to_pybytes().translate(SIGNS), np.uint8)
    ends = ends - ends[0]
    word = signs != 32
    first, begin = word.copy(), ends[:-1][ends[:-1] < ends[1:]]
    first[1:] &= ~word[:-1]
    first[begin] = word[begin]                  # a word ends with its document
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    start = np.flatnonzero(first)
    if not len(start):
        return
    sizes = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - start)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(start), pa.py_buffer(sizes), pa.py_buffer(signs[word])).dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(start, ends)))

    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    of_lang, of_source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
    group = of_lang * len(sources.dictionary) + of_source
    low = (1 << 32) - 1

    def lists(term: np.ndarray, of: np.ndarray, *keys: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Terms (and their languages) with equal keys as lists of at most ``longest``; the terms the lists begin with."""
        order = np.lexsort(keys)
        new = np.flatnonzero(np.append(True, np.any([np.diff(k[order]) != 0 for k in keys], axis=0)))
        begin = np.flatnonzero((np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))) % longest == 0)
        named = pc.binary_join_element_wise(names.take(pa.array(term[order])), langs.dictionary.take(pa.array(of[order])), " ")
        return pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), named), order[begin]

    cell, times = np.unique(group[row] << 32 | code, return_counts=True)
    of, some = np.unique(group, return_index=True)
    some = some[np.searchsorted(of, cell >> 32)]          # a document of the group
    terms, at = lists(cell & low, of_lang[some], times, cell >> 32)
    yield some[at], times[at], terms

    seen = np.sort(row << 32 | code)
    seen = seen[np.append(True, seen[1:] != seen[:-1])]
    cell, docs = np.unique(of_lang[seen >> 32] << 32 | seen & low, return_counts=True)
    docs = np.minimum(docs, MIN_DOCS)
    terms, at = lists(cell & low, cell >> 32, docs)
    yield None, -docs[at], terms


def _windows(docs: DataFrame) -> DataFrame:
    """(lang, source, times, terms): what windows of the documents hold; a term is followed by a blank and its language.

    A group has each of its terms of a window once, in a row of terms that occur there that many times. Rows of -n times
    have the terms of n documents of the window, of ``MIN_DOCS`` or more if n is that.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.forget()
        for batch in _filled(batches, WINDOW):
            lang, source, text = batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary())
            for at, times, terms in _window(lang, source, text, LONGEST):
                names = (pa.array([""] * len(times), pa.string()),) * 2 if at is None else (lang.take(pa.array(at)), source.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([*names, pa.array(times), terms], names=["lang", "source", "times", "terms"])

    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source"))
    return docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(run, ROWS)


def _repeated(seen: DataFrame) -> DataFrame:
    """Rows of 0 times: each (term, docs) term in ``docs`` of them, ``MIN_DOCS`` at most, never twice in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, docs = batch.column(0), np.minimum(batch.column(1).to_numpy(zero_copy_only=False), MIN_DOCS)
            for nth in range(docs.max(initial=0)):
                some = np.flatnonzero(docs > nth)
                begin = np.append(np.arange(0, len(some), LONGEST), len(some)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begin), term.take(pa.array(some)))
                names = pa.array([""] * len(lists), pa.string())
                yield pa.RecordBatch.from_arrays([names, names, pa.array(np.zeros(len(lists), np.int64)), lists], names=["lang", "source", "times", "terms"])

    return seen.mapInArrow(run, ROWS)


def _combined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of 0 times and rows of 1 and more, as ``words`` returns them, and the number of documents of each term, ``MIN_DOCS`` or more if it is that."""
    with shared.rows_per_batch(docs.sparkSession, BATCH):       # whole texts: less to hold at once, in the JVM and in Python
        rows = shared.written(_windows(docs), "terms")
    seen = rows.where("times < 0").select(F.explode("terms").alias("term"), "times").groupBy("term").agg((-F.sum("times")).alias("docs"))
    seen = shared.written(seen, "term-docs")
    return _repeated(seen), rows.where("times > 0"), seen


def words(docs: DataFrame) -> DataFrame:
    """(lang, source, times, terms): what the documents hold; a term is followed by a blank and its language.

    A group has each of its terms of a window of documents once, in a row of terms that occur there that many times. Rows
    of 0 times have each term as often as it has documents, ``MIN_DOCS`` at most, never twice in a row.
    """
    fitted, counted, _ = _combined(docs)
    return fitted.union(counted)


def _dealt(fitted: DataFrame, counted: DataFrame, seen: DataFrame, most: int) -> list[tuple[DataFrame, DataFrame]]:
    """The rows of 0 times and the others with the terms of one shard each, of whose terms about ``most`` are kept."""
    shards = -(-seen.where(F.col("docs") >= MIN_DOCS).count() // most)
    if shards < 2:
        return [(fitted, counted)]
    rows = fitted.union(counted)
    spark, schema = rows.sparkSession, f"{ROWS}, shard int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, of = batch.column(3), batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(row * shards + of, kind="stable")
            cell, start = np.unique((row * shards + of)[order], return_index=True)
            pick, shard = cell // shards, pa.array((cell % shards).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)).astype(np.int32)), terms.flatten().take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(pick)) for i in range(3)), lists, shard], names=["lang", "source", "times", "terms", "shard"])

    marked = rows.withColumn("of", F.transform("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(shards)).cast("int")))
    each = marked.mapInArrow(run, schema)
    path, salts = shared.fresh_path(spark, "terms"), max(1, -(-shared.partitions(spark) // shards))
    each = each.repartition("shard", F.pmod(F.xxhash64("terms"), F.lit(salts)))        # few files, and no shard in one task
    each.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    shared.forget_at_exit(spark, path)
    read = spark.read.schema(schema).parquet(path)
    parts = [read.where(F.col("shard") == k) for k in range(shards)]
    return [(part.where("times = 0"), part.where("times > 0")) for part in parts]


def _summed(vectors: DataFrame, names: list[str]) -> DataFrame:
    """(lang, source, term, count): sparse sums of the (source, times, vector) rows, each taken that many times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, times, vector = batch.columns
            source = source.dictionary_encode()
            at, values = vector.field("indices"), vector.field("values")
            sizes = at.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(source.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            cell, inverse = np.unique(of << 32 | at.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            count = np.zeros(len(cell), dtype=np.int64)
            np.add.at(count, inverse, values.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * np.repeat(times.to_numpy(zero_copy_only=False), sizes))
            yield pa.RecordBatch.from_arrays([source.dictionary.take(pa.array(cell >> 32)), pa.array(cell & ((1 << 32) - 1)), pa.array(count)], names=["source", "at", "count"])

    added = vectors.mapInArrow(run, "source string, at long, count long").groupBy("source", "at").agg(F.sum("count").alias("count"))
    vocabulary = vectors.sparkSession.createDataFrame(pa.table({"at": pa.array(range(len(names)), pa.int64()), "name": names}))
    named = added.join(vocabulary, "at")
    return named.select(F.expr("substring(name, instr(name, ' ') + 1)").alias("lang"), "source", F.expr("substring(name, 1, instr(name, ' ') - 1)").alias("term"), "count")


def counts(docs: DataFrame, most: int = SHARD) -> DataFrame:
    """(lang, source, term, count): occurrences of the kept terms in each group that has them; a written table."""
    from pyspark.ml.feature import CountVectorizer      # not above: Python workers import this module, and need no more of it

    out, spark = None, docs.sparkSession
    for fitted, counted in _dealt(*_combined(docs), most):
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(MIN_DOCS), vocabSize=LARGEST).fit(fitted)
        if not model.vocabulary:
            continue
        part = shared.written(_summed(model.transform(counted).select("source", "times", "vector"), model.vocabulary), "term-counts")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "lang string, source string, term string, count long")


# ------------------------------------------------------------------------------------------- comparison

def _p(count: str, n: str = "n") -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), in decimals where a product is too long for a long."""
    return F.expr(f"if({n} + 2 * v = 0, 0, 1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({n} + 2 * v as decimal(20,0)))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"if({p} + {q} = 0, 0L, (({p} - {q}) * ({p} - {q})) div ({p} + {q}))")


def _met(terms: DataFrame) -> DataFrame:
    """(a, b, more, both): over the terms of both groups, what they add to the sums taken with one count at 0, and their number.

    ``terms`` has one row for each term, with its groups in ascending order: ids, p, and the p of count 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for batch in batches:
            ids, p, zero = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids)) - 1          # groups of the term after this one
            names, group = np.unique(ids, return_inverse=True)
            until = np.cumsum(later)
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(until, (until[low - 1] if low else 0) + PAIRS, side="right")))
                n = later[low:high]
                i = np.repeat(np.arange(low, high), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                low = high
                pair, inverse = np.unique(group[i] * len(names) + group[j], return_inverse=True)
                more, both = np.zeros(len(pair), dtype=np.int64), np.bincount(inverse, minlength=len(pair))
                np.add.at(more, inverse, f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]))
                yield pa.RecordBatch.from_arrays([pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)]), pa.array(more), pa.array(both)], names=["a", "b", "more", "both"])

    return terms.mapInArrow(run, "a long, b long, more long, both long").groupBy("a", "b").agg(F.sum("more").alias("more"), F.sum("both").alias("both"))


def audit(docs: DataFrame, top: int = TOP, most: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the ``top`` terms a group has more of than its language."""
    kept = counts(docs, most)
    whole = kept.groupBy("lang", "term").agg(F.sum("count").alias("total"))
    of_lang = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("own"))
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    groups = docs.select(lang, source).distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0)
    groups = shared.written(groups.withColumn("id", F.monotonically_increasing_id()).withColumn("zero", _p("0")), "groups")
    placed = shared.written(kept.join(groups, ["lang", "source"]).withColumn("p", _p("count")), "placed")

    met = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("id", "p", "zero"))).alias("of")).where(F.size("of") > 1)
    met = _met(met.select("of.id", "of.p", "of.zero"))
    alone = placed.groupBy("lang", "id", "p").agg(F.count("*").alias("terms"))          # one row for each count of a group
    other = groups.select("lang", F.col("id").alias("other"), F.col("zero").alias("q"))
    single = alone.join(other, "lang").where("id <> other").groupBy("id", "other").agg(F.sum(F.col("terms") * _f("p", "q")).alias("single"))
    here, there = groups.select("lang", "source", "id", "zero", "own", "v"), groups.select("lang", F.col("source").alias("item"), F.col("id").alias("other"), F.col("zero").alias("q"), F.col("own").alias("theirs"))
    pairs = here.join(there, "lang").where("id <> other")
    pairs = pairs.join(single, ["id", "other"], "left").join(single.select(F.col("id").alias("other"), F.col("other").alias("id"), F.col("single").alias("back")), ["id", "other"], "left")
    both_ways = met.union(met.select("b", "a", "more", "both")).toDF("id", "other", "more", "both")
    pairs = pairs.join(both_ways, ["id", "other"], "left").na.fill(0, ["single", "back", "more", "both"])
    value = F.col("single") + F.col("back") + F.col("more") + (F.col("v") - F.col("own") - F.col("theirs") + F.col("both")) * _f("zero", "q")
    part = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(part))

    usual = whole.join(of_lang, "lang").select("lang", "term", _p("total", "`all`").alias("q"))
    terms = placed.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    return pairs.union(terms.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top))
