"""Where results go."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_key(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def text_key(text: str) -> str:
    return "txt_" + hashlib.sha256(text.encode()).hexdigest()[:12]


def download_key(key: str, fields: list[str]) -> str:
    return f"{key}_{hashlib.sha256(','.join(sorted(fields)).encode()).hexdigest()[:8]}"


def file_key_of(content: Column) -> Column:
    """file_key() of a binary column."""
    return F.substring(F.sha2(content, 256), 1, 16)


def text_key_of(text: Column) -> Column:
    return F.concat(F.lit("txt_"), F.substring(F.sha2(text, 256), 1, 12))


def download_key_of(key: Column, fields: list[str]) -> Column:
    return F.concat(key, F.lit(f"_{hashlib.sha256(','.join(sorted(fields)).encode()).hexdigest()[:8]}"))


def write_cached(df: DataFrame, path: str, meta: dict) -> None:
    """Parquet, and its meta data as one JSON row beside it, through Spark's own writers."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_cached(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_trace(df: DataFrame, path: str) -> None:
    """The trace of each row as one JSON line."""
    df.select(F.to_json("trace").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV files with headers; with a UTF-8 mark before the header's first name if asked."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, f"﻿{first}") if mark else df
    out.write.mode("overwrite").option("header", True).csv(path)


def export_view(df: DataFrame, internal: list[str], decisions: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """df without internal columns, with mode and score of its decisions; whole quantities as whole numbers."""
    out = df.drop(*[c for c in internal if c in df.columns])
    if "qty" in out.columns:
        out = out.withColumn("qty", F.regexp_replace(F.col("qty").cast("string"), r"\.0$", ""))
    return out.join(decisions.select(key, "mode", "score"), key, "left") if decisions is not None else out


def ok_rows(df: DataFrame) -> DataFrame:
    return df.where("status = 'ok'")


def preview(df: DataFrame, order: str = "row_id", limit: int = 200) -> DataFrame:
    return df.orderBy(order).limit(limit)


def signature_table(items: DataFrame, path: str, version: str, tokens: str = "tokens") -> DataFrame:
    """MinHash signatures of items, written once for a version of them and read again while it lasts."""
    from tallyforge.operators.similarity import signatures

    where = f"{path}/{version}"
    spark = items.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        signatures(items, ["item_id"], tokens).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)
