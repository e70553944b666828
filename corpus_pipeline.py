"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, language_id, minhash, pieces, substring_dedup
from tallyforge.llm.common import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; `lang` becomes the one identified.

    Those that are undetermined go: a null, empty or letterless text, and all of them where no language
    can be learned. Equal rows are judged alike, each by itself; an empty table gives no rows.
    """
    found = language_id.identify(docs.select(COLUMNS), language_id.fit(docs))
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id.

    Rows of one id, and rows without an id, are rows like others; of equal rows one stays. A text
    without words is no duplicate. An empty table gives no rows.
    """
    return minhash.one_of_each(docs.select(COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that recur; those of which nothing is left go, and others keep their text as it is.

    A null text, or one without words, has nothing left and goes. Equal rows would repeat each other,
    but the stage before keeps one. An empty table gives no rows.
    """
    stripped = substring_dedup.remove_repeats(docs.select(COLUMNS), keep_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return stripped.where("n_words > n_removed").select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null texts and items hold none. Equal rows are judged alike; empty tables give no rows, or all.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(COLUMNS), items)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip and ids of each document; none for a null or empty text, and no rows for an empty table."""
    return pieces.tokenized(docs, pieces.load(), with_ids=True)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]
#: The first and the last stage have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
