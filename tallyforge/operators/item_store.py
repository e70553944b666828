"""The catalogue as a store that a full feed is synced into, of which only what differs is written.

Items lie in buckets by their keys. A version's log says for each bucket in which version's folder it lies, and
a digest of its active items. A feed's buckets are digested in one pass; only buckets whose digests differ are
read, compared with catalog.sync() and written, into folders of the new version. Nothing is overwritten, so a
reader keeps the version it opened, and a sync that breaks off leaves the last version as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import catalog
from tallyforge.operators.graph import saved


@dataclass
class ItemStore:
    """A store under a path that all executors share. buckets: how finely a change is told from what stays; fixed for the life of a store."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("uid", "char")
    values: tuple[str, ...] = ("name",)
    buckets: int = 64

    def _bucket(self, df: DataFrame) -> DataFrame:
        """df with its keys as text, '' for null, and their bucket."""
        own = df.withColumns({k: T.text(k) for k in self.keys})
        return own.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _digests(self, df: DataFrame) -> DataFrame:
        names = [*self.keys, *self.values]
        return df.groupBy("__bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*names)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *names)).alias("y"))

    def version(self) -> int | None:
        """The latest complete version, null for an empty store."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        log = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not fs.exists(log):
            return None
        done = [int(s.getPath().getName()) for s in fs.listStatus(log) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=None)

    def _log(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log/{version}")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Keys, values and is_active of a version (the latest, if not given)."""
        version = self.version() if version is None else version
        rows = self._log(version).collect()  # one for each bucket
        folders = [f"{self.path}/items/{r['version']}/__bucket={r['__bucket']}" for r in rows if buckets is None or r["__bucket"] in buckets]
        shape = self.spark.read.parquet(f"{self.path}/items/{version if not rows else rows[0]['version']}").drop("__bucket").schema
        return self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)

    def sync(self, feed: DataFrame) -> tuple[int, DataFrame]:
        """The version after a full feed, and what it changed: keys, action (created, updated, deactivated), values and is_active.

        A feed that says what the store holds makes no version. A null key part is an empty one; of rows of one
        key the largest counts; items the feed lacks are kept as inactive. An empty feed deactivates all.
        """
        old = self.version()
        one = self._bucket(feed.select(*self.keys, *self.values)).groupBy(*self.keys, "__bucket").agg(F.max(F.struct(*self.values)).alias("__v")).select(*self.keys, "__bucket", "__v.*")
        one = saved(one)
        now = self._digests(one)
        if old is None:
            known = now.where("false").withColumn("version", F.lit(0))
        else:
            known = self._log(old)
        both = known.select("__bucket", F.struct("n", "x", "y").alias("was"), "version").join(now.select("__bucket", F.struct("n", "x", "y").alias("is")), "__bucket", "full_outer")
        # A bucket without active items has no digest in a feed and counts as none in the log.
        none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "x", "y")])
        differs = ~F.coalesce(F.col("was"), none).eqNullSafe(F.coalesce(F.col("is"), none))
        touched = sorted(r["__bucket"] for r in both.where(differs).select("__bucket").collect())  # `buckets` at most
        version = 0 if old is None else old + 1
        stored = None if old is None else [r["__bucket"] for r in known.select("__bucket").collect()]
        if old is not None and not touched:
            return old, self._changes(self.read(old, []).withColumn("action", F.lit("")))
        mine = one.where(F.col("__bucket").isin(touched)).drop("__bucket")
        before = mine.withColumn("is_active", F.lit(True)).where("false") if old is None else self.read(old, [b for b in touched if b in stored])
        result = saved(catalog.sync(before, mine, list(self.keys), list(self.values)))
        kept = self._bucket(result.drop("action"))
        kept.repartition("__bucket").sortWithinPartitions(*self.keys).write.partitionBy("__bucket").mode("overwrite").parquet(f"{self.path}/items/{version}")
        fresh = self._bucket(result.drop("action")).groupBy("__bucket").agg(F.lit(1)).select("__bucket").join(self._digests(kept.where("is_active")), "__bucket", "left")
        fresh = fresh.select("__bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "x", "y")], F.lit(version).alias("version"))
        rest = known.where(~F.col("__bucket").isin(touched)).select("__bucket", "n", "x", "y", F.col("version").cast("int").alias("version"))
        fresh.unionByName(rest).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{version}")
        return version, self._changes(result)

    def _changes(self, result: DataFrame) -> DataFrame:
        return result.where(F.col("action").isin("created", "updated", "deactivated")).select(*self.keys, "action", *self.values, "is_active")
