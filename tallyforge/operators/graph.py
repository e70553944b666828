"""Intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's own setting; one is set only where there is none, as in tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it; Spark itself distributes the file."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    to = Path(folder) / f"{root.name}_core.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder, so that a lost executor loses none of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsaved(*frames: DataFrame | None) -> None:
    """Delete what saved() wrote for these, once nothing reads it any more."""
    for df in frames:
        if df is None:
            continue
        jvm = df.sparkSession._jvm
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            if path.getName().startswith("tallyforge-"):
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of an edge that is not the smallest of its component.

    Alternating large-star and small-star steps on the edge list; every step is joins and minima
    with partial aggregation, so neither a large component nor a node with very many edges gathers
    in one task. The edges are written out after each round.
    """
    big = lambda df, u, v: df.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    e = saved(big(edges, a, b))
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = saved(small.distinct())
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        unsaved(e, large)
        e = after
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now
