"""The driver's tables read as order lines, a catalogue and quotes; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import seeds
from tallyforge.functions import text as T

TYPES = ("bolt", "ring", "rod", "plate", "gear", "gizmo", "widget", "anvil")
DICTIONARY = X.Dictionary(seeds.default_dictionary().rules, tuple(X.ItemType(t) for t in TYPES))


def register(queries: dict, oracles: dict):
    """A decorator that registers a query under its name, with its SQL where there is some."""

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: dealt out anew if it has fewer partitions than that, as one small file has; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has, before costly expressions: a small file, or a table broadcast to one, is a single task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, place, order_id, supplier_id, part_id, price and raw_text of each order line; the id is made of the columns that tell lines apart, so nothing is grouped for it, and is a text, as their numbers have no bound. place is a number that rises with orders and lines."""
    l = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    s = lambda c: c.cast("string")
    strength = F.when(F.col("l_partkey") % 3 == 0, " 8.8").when(F.col("l_partkey") % 3 == 1, " 10.9").otherwise("")
    zinc = F.when(F.col("l_linenumber") % 2 == 0, " zinc").otherwise("")
    raw = F.concat("p_name", F.lit(" M"), s(F.col("p_size")), F.lit("x"), s(F.col("l_quantity").cast("int")), F.lit(" DIN "), s(F.lit(931) + F.col("l_partkey") % 4), strength, zinc, F.lit(" "), s(F.col("l_linenumber")), F.lit(" pcs"))
    return l.join(p, "l_partkey").select(
        F.concat_ws("-", *[s(F.col(c)) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], s(F.col("l_quantity").cast("int"))).alias("row_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000 + F.col("l_partkey") % 1_000).alias("place"), F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("part_id"),
        F.col("l_extendedprice").alias("price"), raw.alias("raw_text"),
    )


LINES = """lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS row_id, (l_orderkey * 10 + l_linenumber) * 1000 + l_partkey % 1000 AS place, l_orderkey AS order_id, l_suppkey AS supplier_id, l_partkey AS part_id, l_extendedprice AS price,
    p_name || ' M' || p_size || 'x' || l_quantity::INT || ' DIN ' || (931 + l_partkey % 4)
      || CASE l_partkey % 3 WHEN 0 THEN ' 8.8' WHEN 1 THEN ' 10.9' ELSE '' END || CASE l_linenumber % 2 WHEN 0 THEN ' zinc' ELSE '' END
      || ' ' || l_linenumber || ' pcs' AS raw_text
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def records(spark: SparkSession, sf_dir: str, more=None) -> DataFrame:
    """Lines with all fields, which are extracted once from each different text, as is what more() adds to the texts with their fields."""
    def fields(t):
        own = X.line_record(t, DICTIONARY).withColumns({"std_key": F.coalesce(T.standard_key("din"), F.lit("")), "name": F.col("raw_text")})
        return more(own) if more else own

    return X.of_texts(lines(spark, sf_dir), "raw_text", fields)


RECORDS = LINES + """, records AS (
  SELECT *, regexp_extract(raw_text, '(bolt|ring|rod|plate|gear|gizmo|widget|anvil)') AS item_type, regexp_extract(raw_text, 'M[0-9]+x[0-9]+') AS size,
    regexp_extract(raw_text, '(M[0-9]+)x', 1) AS diameter, regexp_extract(raw_text, 'M[0-9]+x([0-9]+)', 1) AS length,
    regexp_extract(raw_text, ' (8\\.8|10\\.9)', 1) AS strength, CASE WHEN raw_text LIKE '%zinc%' THEN 'цинк' ELSE '' END AS coating,
    regexp_extract(raw_text, 'DIN [0-9]+') AS din, replace(regexp_extract(raw_text, 'DIN [0-9]+'), ' ', '-') AS std_key FROM lines)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: each part with a type, size, standard and folder."""
    k = F.col("p_partkey")
    p = spread(table(spark, sf_dir, "part")).select(
        k.alias("item_id"), F.col("p_name").alias("name"), F.get(F.split("p_name", " "), F.lit(1)).alias("item_type"), F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit("x"), (k % 50 + 1).cast("string")).alias("size"),
        F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("diameter"), (k % 50 + 1).cast("string").alias("length"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("DIN-"), (k % 4 + 931).cast("string"))).alias("standard_key"),
        F.when(k % 3 == 0, "8.8").otherwise("").alias("strength"), F.when(k % 2 == 0, "цинк").otherwise("").alias("coating"), F.when(k % 5 > 0, (k % 5).cast("int")).alias("folder_priority"),
        F.when(k % 6 == 0, "_old").otherwise("main").alias("folder_path"), F.concat(F.lit("G"), k.cast("string")).alias("uid_1c"), (k % 10 != 0).alias("is_active"),
    )
    return p.withColumns({
        "type_norm": T.clean("item_type"), "size_norm": T.normalize_size("size"), "std_key": F.col("standard_key"), "std_norm": F.col("standard_key"),
        "canonical_key": T.canonical_key("item_type", F.col("standard_key"), "size"),
    })


ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS name, split_part(p_name, ' ', 2) AS item_type, 'M' || p_size || 'x' || (p_partkey % 50 + 1) AS size, upper('M' || p_size || 'x' || (p_partkey % 50 + 1)) AS size_norm,
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'DIN-' || (931 + p_partkey % 4) END AS std_key, CASE WHEN p_partkey % 3 = 0 THEN '8.8' ELSE '' END AS strength, CASE WHEN p_partkey % 2 = 0 THEN 'цинк' ELSE '' END AS coating,
    CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 5)::INT END AS folder_priority, CASE WHEN p_partkey % 6 = 0 THEN '_old' ELSE 'main' END AS folder_path, 'G' || p_partkey AS uid_1c, p_partkey % 10 <> 0 AS is_active,
    array_to_string(list_sort([p_size::INT, (p_partkey % 50 + 1)::INT]), 'x') AS size_key,
    'type=' || split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '|std=DIN-' || (931 + p_partkey % 4) END || '|size=' || array_to_string(list_sort([p_size::INT, (p_partkey % 50 + 1)::INT]), 'x') AS canonical_key
  FROM part)"""


def equivalents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("DIN-931", "DIN-933", True), ("DIN-932", "DIN-934", False)], "src_canonical string, dst_canonical string, is_active boolean")


EQUIVALENTS = "eq AS (SELECT * FROM (VALUES ('DIN-931', 'DIN-933'), ('DIN-933', 'DIN-931')) AS t(a, b))"


def tokens(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("tokens", T.char_ngrams(T.similarity_text(name), 4))
