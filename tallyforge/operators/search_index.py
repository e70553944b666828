"""Substring search by n-gram postings, for many queries at once.

Postings (gram, item) of all stretches of up to three characters are a table bucketed by gram. A query looks
up the RAREST rarest of its own n-grams, items that have all of these are looked at, and what the real columns say
decides. Equal queries are searched once. Queries are moved to the postings' buckets; the postings stay where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import similarity as S
from tallyforge.operators.graph import saved, ship
from tallyforge.operators.rule_index import grams

LENGTHS = (3, 2, 1)
#: N-grams of a query whose postings are intersected.
RAREST = 3


def _postings(df: DataFrame, key: str, text: str, longest: bool) -> DataFrame:
    """(key, gram): of all lengths, or of the largest length alone that the text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            groups = [(n, [i for i, t in enumerate(texts) if min(len(t), LENGTHS[0]) == n]) for n in LENGTHS] if longest else [(LENGTHS, range(len(texts)))]
            for n, rows in groups:
                place, h = grams([texts[i] for i in rows], n if isinstance(n, tuple) else (n,))
                at = pa.array([rows[p] for p in place.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(h)], ["key", "gram"])

    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, gram long").withColumnRenamed("key", key)


@dataclass
class SearchIndex:
    """An index of the columns of items under a name in the session's warehouse."""

    spark: SparkSession
    name: str
    columns: tuple[str, ...]
    buckets: int = 16

    def build(self, items: DataFrame, key: str = "item_id") -> SearchIndex:
        """Postings and their counts; items whose columns are all null or empty are found by no query but the empty one."""
        text = F.concat_ws("\u0000", *[F.lower(T.text(c)) for c in self.columns])
        own = _postings(items.select(F.col(key).alias("item_id"), text.alias("text")), "item_id", "text", False)
        own.repartition(self.buckets, "gram").write.format("parquet").bucketBy(self.buckets, "gram").sortBy("gram").saveAsTable(f"{self.name}_postings")
        counts = self.spark.table(f"{self.name}_postings").groupBy("gram").agg(F.count("*").alias("n"))
        counts.write.format("parquet").bucketBy(self.buckets, "gram").saveAsTable(f"{self.name}_counts")
        return self

    def search(self, queries: DataFrame, items: DataFrame, order: list[Column], limit: int = 20, key: str = "item_id") -> DataFrame:
        """(query_id, the key, the columns, rank): for each (query_id, query) what catalog.search() gives: the first `limit` items one of whose columns holds the query, whatever its case.

        An empty or null query is held by every item, and so finds the first `limit` of them.
        """
        every = saved(queries.select("query_id", F.lower(T.text("query")).alias("__q")))
        # Equal queries are searched once: their text stands for them until their results are handed out.
        asked = every.select("__q").distinct()
        own = _postings(asked.where("__q <> ''").withColumn("query", F.col("__q")), "__q", "query", True)
        # A gram that no item has counts as the rarest: its query finds nothing.
        counted = own.join(self.spark.table(f"{self.name}_counts"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        chosen = saved(S.top_k(counted, "__q", [F.col("n"), F.col("gram")], RAREST, "r").select("__q", "gram"))
        wanted = chosen.groupBy("__q").agg(F.count("*").alias("wanted"))
        met = chosen.join(self.spark.table(f"{self.name}_postings"), "gram").groupBy("__q", "item_id").agg(F.count("*").alias("n"))
        met = met.join(wanted, "__q").where("n = wanted").select("__q", F.col("item_id").alias(key))
        rows = items.select(key, *[c for c in items.columns if c != key])
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.lower(T.text(c)).contains(F.col("__q"))
        found = met.join(rows, key).where(hit)
        # Every item holds the empty query, so its result is made once, whoever asks.
        first = items.orderBy(*order).limit(limit)
        empty = asked.where("__q = ''").join(F.broadcast(first), F.lit(True))  # `limit` rows
        out = found.unionByName(empty)
        best = S.top_k(out, "__q", order, limit).select("__q", key, *[c for c in self.columns if c != key], "rank")
        return every.join(best, "__q").drop("__q")

    def drop(self) -> None:
        for kind in ("postings", "counts"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
