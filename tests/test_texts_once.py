"""What is costly is done once a text or once a request, whatever the number of rows."""

from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import text as T
from tallyforge.operators import matching
from tallyforge.operators import rules as R
from tallyforge.plans import base


def _joins(df, *kinds):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [sum(k in line for line in plan.splitlines()) for k in kinds]


def test_each_text_once_and_every_row_kept(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, None)], "id int, raw string")
    seen = []

    def add(texts):
        seen.extend(r.raw for r in texts.collect())
        return texts.withColumn("up", F.upper("raw"))

    got = X.of_texts(df, "raw", add).orderBy("id").collect()
    assert [(r.id, r.raw, r.up) for r in got] == [(1, "a", "A"), (2, "a", "A"), (3, None, None), (4, "b", "B"), (5, None, None)]
    assert sorted(seen, key=str) == [None, "a", "b"]


def test_a_standards_directory_is_sent_not_shuffled(spark):
    rows = spark.createDataFrame([(i, "", "", "DIN 931", "") for i in range(20)], "id int, gost string, iso string, din string, item_type string")
    out = R.enrich(rows, spark.createDataFrame([("DIN", "931", "bolt")], "kind string, code string, item_type string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _joins(out, "SortMergeJoin", "BroadcastHashJoin") == [0, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.item_type, r.standard_type) for r in out.collect()} == {("bolt", "bolt")}


def _items(spark):
    return spark.createDataFrame(
        [(1, "bolt a", True, "bolt", "M8", "", "", "", "", "k1", 1, "main"), (2, "bolt b", True, "bolt", "M8", "DIN-1", "DIN-1", "8.8", "", "k2", 2, "main"), (3, "nut", False, "nut", "M8", "", "", "", "", "k3", 1, "main")],
        "item_id long, name string, is_active boolean, type_norm string, size_norm string, std_norm string, std_key string, strength string, coating string, canonical_key string, folder_priority int, folder_path string",
    )


def _rows(spark, n):
    r = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 2, "nut").otherwise("bolt").alias("type_norm"), F.lit("M8").alias("size_norm"))
    return r.withColumns({"std_key": F.when(F.col("row_id") % 3 == 1, "DIN-1"), "std_norm": F.lit(""), "strength": F.lit("8.8"), "coating": F.lit(None).cast("string"), "fingerprint": F.when(F.col("row_id") == 0, "f")})


def test_equal_requests_meet_the_catalogue_once(spark):
    rows, items = _rows(spark, 30), _items(spark)
    asked = matching.asked_candidates(matching._asked(rows), items)
    assert asked.count() == 4  # of two different requests that have some, not of twenty rows
    got = {(r.row_id % 3, r.item_id, r.rank) for r in matching.exact_candidates(rows, items).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (1, 2, 1), (1, 1, 2)}


def test_decisions_of_every_stage_without_similarity(spark):
    memory = spark.createDataFrame([("f", 1, 5), ("f", 3, 9), ("g", 1, 1)], "fingerprint string, item_id long, confirmed_at int").where("item_id <> 3")
    got = {r.row_id: (r.mode, r.item_id, r.score, [c.item_id for c in r.candidates]) for r in matching.decide(_rows(spark, 6), _items(spark), matching.Settings(similar=False), memory).collect()}
    assert got == {0: ("AUTO_MEMORY", 1, 100, [1]), 1: ("AUTO_EXACT", 2, 100, [2, 1]), 2: ("NONE", None, 0, []), 3: ("AUTO_EXACT", 1, 100, [1, 2]), 4: ("AUTO_EXACT", 2, 100, [2, 1]), 5: ("NONE", None, 0, [])}


def test_options_are_computed_once(spark):
    df = spark.createDataFrame([("az",), ("",)], "t string").select(T.let(F.col("t"), lambda t: T.first(T.group(t, "(z+)", 1), F.lit("none"))).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(z+)") == 1
    assert [r.x for r in df.collect()] == ["z", "none"]


def test_goods_are_made_in_all_tasks(spark):
    assert base.items(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
