"""Counts, rates and accuracies."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.graph import saved

AUTO_MODES = ("AUTO_MEMORY", "AUTO_MINHASH", "AUTO_ANALOG")
SUGGESTED_MODES = ("SUGGESTED", "SUGGESTED_ANALOG")
# Fields counted as recognised, and which of them make a group's rate.
EXPECTED_FIELDS = ("item_type", "size", "diameter", "length", "strength", "coating", "gost", "din", "iso")
RATE_FIELDS = {"size": ("size",), "strength": ("strength",), "coating": ("coating",), "standard": ("gost", "din", "iso")}


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    """a / b, rounded half to even; 0 without a denominator."""
    return F.when(b > 0, F.bround(a.cast("double") / b, places)).otherwise(0.0)


def status_counts(df: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return df.agg(n("ok").alias("ok"), n("review").alias("review"), n("manual").alias("manual"), F.count("*").alias("total"), F.coalesce(F.bround(100 * n("ok") / F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("int").alias("ok_pct"))


def match_summary(df: DataFrame, recognised: str = "item_type") -> DataFrame:
    """Counts of modes. AUTO_EXACT is not among the automatic modes here and counts as not matched."""
    auto, some = F.col("mode").isin(*AUTO_MODES), F.col("mode").isin(*SUGGESTED_MODES)
    return df.agg(F.count("*").alias("total"), F.count_if(auto).alias("auto"), F.count_if(some).alias("suggested"), F.count_if(~auto & ~some).alias("not_matched"), F.count_if(T.text(recognised) != "").alias("recognised"))


def top_unknown_words(df: DataFrame, name: str = "name", recognised: str = "item_type", k: int = 15) -> DataFrame:
    """The most frequent first words of names without a type."""
    word = F.get(F.split(F.trim(F.lower(T.text(name))), r"(?U)\s+"), F.lit(0))
    return df.where(T.text(recognised) == "").select(word.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def order_counts(orders: DataFrame, lines: DataFrame, items: DataFrame, quotes: DataFrame) -> DataFrame:
    out = orders
    for df, name in ((lines, "n_lines"), (items, "n_items"), (quotes, "n_quotes")):
        out = out.join(df.groupBy("order_id").agg(F.count("*").alias(name)), "order_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def last_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def quality(runs: DataFrame, n: int = 50) -> DataFrame:
    """Rates over the last n runs."""
    r = last_runs(runs, n)
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return r.agg(
        F.count("*").alias("total_runs"), s("total_client_lines").alias("total_client_lines"), ratio(s("parsed_client_lines"), s("total_client_lines")).alias("parse_success_rate"),
        ratio(s("auto_matches"), s("total_client_lines")).alias("auto_match_rate"), ratio(s("manual_matches"), s("total_client_lines")).alias("manual_match_rate"),
        ratio(s("system_match_correct"), s("system_match_correct") + s("system_match_incorrect")).alias("match_accuracy"), ratio(s("auto_matches"), s("total_client_lines")).alias("full_auto_rate"),
    )


def history(runs: DataFrame, n: int = 50) -> DataFrame:
    """The last n runs, oldest first, with their own rates."""
    c = F.col
    return last_runs(runs, n).orderBy("created_at", "id").select(
        "id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("date"), ratio(c("parsed_client_lines"), c("total_client_lines")).alias("parse_success_rate"),
        ratio(c("auto_matches"), c("total_client_lines")).alias("auto_match_rate"), ratio(c("system_match_correct"), c("system_match_correct") + c("system_match_incorrect")).alias("match_accuracy"),
    )


def step_means(steps: DataFrame, keys: list[str], step: str | None = None, json: str = "extra_json", name: str = "step_name") -> DataFrame:
    """Means of JSON numbers over the steps with JSON; a step without a key counts 0."""
    rows = steps.where(F.col(json).isNotNull())
    rows = rows.where(F.col(name) == step) if step else rows
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(F.get_json_object(json, f"$.{k}").try_cast("double"), F.lit(0.0))), 4).alias(k) for k in keys])


def correction_rate(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Overrides per automatic match of the runs, in one row."""
    own = feedback.join(runs.select(F.col("id").alias("pipeline_run_id")), "pipeline_run_id", "left_semi")
    rows = own.select(F.lit(1).alias("f"), (~F.col("is_correct")).cast("int").alias("o"), F.lit(0).cast("long").alias("a")).unionByName(runs.select(F.lit(0).alias("f"), F.lit(0).alias("o"), F.col("auto_matches").cast("long").alias("a")))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(s("f").alias("total_feedbacks"), s("o").alias("overrides"), ratio(s("o"), s("a")).alias("correction_rate"))


def recognition(df: DataFrame) -> DataFrame:
    """Share of fields found, and of rows with a size, strength, coating and standard."""
    have = lambda f: T.text(f) != ""
    some = {k: sum((have(f).cast("int") for f in fs[1:]), have(fs[0]).cast("int")) > 0 for k, fs in RATE_FIELDS.items()}
    fields = sum((have(f).cast("int") for f in EXPECTED_FIELDS[1:]), have(EXPECTED_FIELDS[0]).cast("int"))
    n = F.count("*")
    return df.agg(ratio(F.sum(fields), n * len(EXPECTED_FIELDS)).alias("field_recognition_rate"), *[ratio(F.count_if(v), n).alias(f"{k}_recognition_rate") for k, v in some.items()])


def agrees(got: Column, expected: Column) -> Column:
    """Trimmed and whatever its case; null without an expectation."""
    return F.when(F.coalesce(expected, F.lit("")) == "", F.lit(None).cast("boolean")).otherwise(F.lower(F.trim(F.coalesce(got, F.lit("")))) == F.lower(F.trim(expected)))


def evaluation(rows: DataFrame, fields: list[str], source: str = "source_type") -> DataFrame:
    """(source, checks, correct, accuracy) over all fields: got_<f> against expected_<f>; accuracy is null without checks."""
    marks = [agrees(F.col(f"got_{f}"), F.col(f"expected_{f}")) for f in fields]
    checks = sum((m.isNotNull().cast("int") for m in marks[1:]), marks[0].isNotNull().cast("int"))
    right = sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks[1:]), F.coalesce(marks[0], F.lit(False)).cast("int"))
    g = rows.groupBy(source).agg(F.sum(checks).alias("checks"), F.sum(right).alias("correct"))
    return g.withColumn("accuracy", F.when(F.col("checks") > 0, F.bround(F.col("correct") / F.col("checks"), 4)))


def field_stats(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, checks, correct, errors)."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), agrees(F.col(f"got_{f}"), F.col(f"expected_{f}")).alias("ok")) for f in fields])).alias("x"))
    return long.groupBy("x.field").agg(F.count("x.ok").alias("checks"), F.count_if("x.ok").alias("correct"), F.count_if(~F.col("x.ok")).alias("errors"))


def errors(rows: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, field, got, expected) of the fields that are wrong."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"got_{f}").alias("got"), F.col(f"expected_{f}").alias("expected"), agrees(F.col(f"got_{f}"), F.col(f"expected_{f}")).alias("ok")) for f in fields]
    return rows.select(key, F.explode(F.array(*cells)).alias("x")).where("NOT x.ok").select(key, "x.field", "x.got", "x.expected")


def timed(name: str, step: Callable[[DataFrame], DataFrame], df: DataFrame) -> tuple[DataFrame, dict]:
    """A step's result, and its name, rows in and out, success rate and seconds; the result is written out, so that the step runs once."""
    began = time.time()
    seen, made = Observation(), Observation()
    out = saved(step(df.observe(seen, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n")))
    n, m = seen.get["n"], made.get["n"]
    return out, {"step_name": name, "input_rows": n, "output_rows": m, "success_rate": round(m / n, 4) if n else 0.0, "seconds": time.time() - began}


# Parts that merge


def parts(df: DataFrame, by: list[str], value: str, entity: str) -> DataFrame:
    """One row for each `by`: n, total, least and most of value, with sketches of its different entities (HyperLogLog) and of its values (KLL). Null values count in n alone."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.hll_sketch_agg(F.col(entity).cast("string")).alias("entities"), F.kll_sketch_agg_double(v).alias("values"))


def keep_parts(made: DataFrame, path: str, run: str) -> None:
    """Put parts(.., [run, ..]) under path, a folder for each run. Parts of a run that is there already are replaced, so a batch that is run again changes nothing."""
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """parts() of all runs together, by fewer columns: what parts() of all rows would say, sketches within their errors."""
    return kept.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("entities").alias("entities"), F.kll_merge_agg_double("values").alias("values"),
    )


def shown(kept: DataFrame) -> DataFrame:
    """Parts with estimates in place of sketches: entities, and the median of the values; mean and median are null without values."""
    some = F.kll_sketch_get_n_double("values")
    return kept.withColumns({"mean": F.try_divide("total", some), "entities": F.hll_sketch_estimate("entities"), "median": F.when(some > 0, F.kll_sketch_get_quantile_double("values", F.lit(0.5)))}).drop("values")
