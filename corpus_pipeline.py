"""A corpus pipeline: language, near copies, repeated passages, source mixture, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import language_id, mixing, near_dedup, shared, substring_dedup, word_bpe

LEAST_KNOWN = 0.5       # of the share of n-grams usual in labelled rows of the language; texts below it are in no learned language
ENTROPY = 0.88          # of the source weights, as a part of the largest possible


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters, without sense or in a language not learned go."""
    shared.ship(spark)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))        # the text travels once, inside
    found = language_id.predict(rows, model, text="row.text")
    return found.where((F.col("language.lang_pred") != language_id.UNKNOWN) & (F.col("language.known") >= LEAST_KNOWN)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    return near_dedup.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start in an earlier document; texts that lose nothing stay as they are."""
    done = substring_dedup.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.{c}").alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for: each once at least, some sources again."""
    return mixing.mix(docs, entropy=ENTROPY, repetition=4.0, budget=None).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests."""
    return word_bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("mixture", mixture), ("token_ids", token_ids)]

#: The first two stages train a classifier and draw signatures: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
