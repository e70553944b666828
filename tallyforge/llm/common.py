"""Shared plumbing of the operators in this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import BLOCK_BYTES, blocks
from tallyforge.operators import graph
from tallyforge.operators.graph import components, saved, shared_dir, unsaved  # noqa: F401

#: Share of a document's rows that fit no model: the remainder of crc32(doc_id as text) modulo 5.
FOLDS = 5


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS).cast("int")


def piece(text, doc_id, longest: int) -> F.Column:
    """The text, or of a longer one `longest` characters from a place that a hash of the id gives."""
    over = F.greatest(F.char_length(text) - longest, F.lit(0)) + 1
    return F.substr(text, (F.pmod(F.xxhash64(doc_id, F.lit("piece")), over) + 1).cast("int"), F.lit(longest))


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a record batch sent to Python, where the session keeps Spark's default of 10,000: whole texts may be long.
TEXT_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and make the session's Arrow batches TEXT_ROWS long, unless another length than the default is set.

    The length is read when a plan runs, so it stays for the session.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)
    graph.ship(spark)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """While this lasts, Arrow batches hold at most so many rows; for actions on rows that carry whole sets."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, min(int(before), most) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def give_back() -> None:
    """Return memory that this process has freed to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_blocks(df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Apply `each` to record batches of bounded text size; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, column, limit):
            out = each(batch)
            if out is not None and out.num_rows:
                yield out
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
