"""Queries of scalar functions, extraction and rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import text as T
from tallyforge.functions import vocab as V
from tallyforge.operators import rules as R
from tallyforge.operators import snapshot
from tallyforge.operators.graph import saved
from tallyforge.plans.base import DICTIONARY, ITEMS, LINES, RECORDS, items, lines, records, table
from tallyforge.sources import readers

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT p_partkey, upper('M' || p_size || 'X' || (p_partkey % 50 + 1)) AS size_norm, array_to_string(list_sort([p_size::INT, (p_partkey % 50 + 1)::INT]), 'x') AS size_key FROM part")
def size_normalize(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("М "), F.col("p_size").cast("string"), F.lit(" × "), (k % 50 + 1).cast("string"), F.lit("мм"))
    return table(spark, d, "part").select("p_partkey", T.normalize_size(raw).alias("size_norm"), T.size_key(raw).alias("size_key"))


@query("SELECT p_partkey, p_size > 0 AND abs(p_size - (p_size + 1)) / (p_size + 1) <= 0.05 AS close FROM part")
def sizes_close(spark, d):
    a = lambda x: F.array(F.lit(10.0), x.cast("double"))
    return table(spark, d, "part").select("p_partkey", T.sizes_close(a(F.col("p_size")), a(F.col("p_size") + 1), 0.05).alias("close"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), 'ёх×*_-', 'еxxx  '), '(\d),(\d)', '\1.\2', 'g'), '[^а-яa-z0-9\s.x]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT item_id, {_NORM} AS norm FROM benchmark")
def minhash_text_norm(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.similarity_text("text").alias("norm"))


@query(f"""WITH n AS (SELECT item_id, replace({_NORM}, ' ', '_') AS t FROM benchmark)
SELECT item_id, len(list_distinct(list_transform(generate_series(1, greatest(length(t) - 3, 1)), lambda i: substr(t, i, 4))))::BIGINT AS n_grams FROM n""")
def char_ngrams(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.char_ngrams(T.similarity_text("text"))).cast("long").alias("n_grams"))


@query(r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[а-яёa-z]{3,}')), lambda w: NOT list_contains(['для','при','без','над','под','про','все','the','and','for','not'], w))), ' '), '') AS words FROM documents""")
def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.keywords("text"), " ").alias("words"))


@query("SELECT p_partkey, p_name AS key FROM part")
def name_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.name_key(F.concat(F.upper("p_name"), F.lit("  шт., мм"))).alias("key"))


@query(f"""WITH {RECORDS} SELECT row_id, substr(sha1('item_type=' || item_type || '|size=' || lower(size) || '|diameter=' || lower(diameter) || '|length=' || length || '|din=' || lower(din)
  || CASE WHEN strength <> '' THEN '|strength=' || strength ELSE '' END || CASE WHEN coating <> '' THEN '|coating=' || coating ELSE '' END), 1, 16) AS fingerprint FROM records""")
def fingerprint(spark, d):
    r = records(spark, d)
    return r.select("row_id", T.fingerprint({f: F.col(f) for f in ("item_type", "size", "diameter", "length", "gost", "iso", "din", "strength", "coating")}).alias("fingerprint"))


@query(f"WITH {ITEMS} SELECT item_id, canonical_key FROM items")
def canonical_key(spark, d):
    return items(spark, d).select("item_id", "canonical_key")


@query(f"WITH {RECORDS} SELECT row_id, item_type, size, diameter, length, strength, coating, din FROM records")
def extract_fields(spark, d):
    return records(spark, d).select("row_id", "item_type", "size", "diameter", "length", "strength", "coating", "din")


@query(f"WITH {LINES} SELECT row_id, replace(regexp_extract(raw_text, 'DIN [0-9]+'), ' ', '-') || ',ISO-4017' AS keys FROM lines")
def extract_standards(spark, d):
    keys = lambda t: t.withColumn("keys", F.array_join(T.standard_keys(F.concat("raw_text", F.lit(" / ISO 4017"))), ","))
    return X.of_texts(lines(spark, d), "raw_text", keys).select("row_id", "keys")


@query(f"WITH {LINES} SELECT row_id, regexp_replace(raw_text, ' [0-9]+ pcs$', '') AS clean, regexp_extract(raw_text, '([0-9]+) pcs$', 1)::DOUBLE AS qty, 'шт' AS uom FROM lines")
def qty_uom_tail(spark, d):
    t = lines(spark, d).select("row_id", T.tail_quantity("raw_text").alias("t"))
    return t.select("row_id", "t.clean", "t.qty", "t.uom")


@query(f"WITH {LINES} SELECT row_id, regexp_extract(raw_text, '([0-9]+) pcs$', 1)::DOUBLE AS qty, 'кг' AS uom, 'из колонки количества' AS source FROM lines")
def qty_uom_column(spark, d):
    cell = F.concat(T.group(F.col("raw_text"), "([0-9]+) pcs$", 1), F.lit(" кг"))
    p = lines(spark, d).select("row_id", T.preprocess_row("raw_text", cell, None, None, None, True).alias("p"))
    return p.select("row_id", "p.qty", "p.uom", "p.source")


@query(f"WITH {LINES} SELECT row_id, regexp_replace(raw_text, ' [0-9]+ pcs$', '') AS name, regexp_extract(raw_text, '([0-9]+) pcs$', 1)::DOUBLE AS qty, 'шт' AS unit FROM lines")
def parse_text_line(spark, d):
    return lines(spark, d).select("row_id", readers.parse_line("raw_text").alias("p")).select("row_id", "p.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'шт' WHEN 1 THEN 'кг' WHEN 2 THEN 'м²' END AS uom FROM part")
def uom_normalize(spark, d):
    raw = F.element_at(F.array(F.lit("Штук."), F.lit(" КГ"), F.lit("кв.м"), F.lit("box")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.normalize_uom(raw).alias("uom"))


@query(f"WITH {RECORDS}, c AS (SELECT row_id, 3 + (strength <> '')::INT + (coating <> '')::INT AS confidence FROM records) SELECT row_id, confidence::BIGINT AS confidence, CASE WHEN confidence >= 4 THEN 'ok' WHEN confidence >= 2 THEN 'review' ELSE 'manual' END AS status FROM c")
def confidence_status(spark, d):
    t = X.transform(lines(spark, d).select("row_id", "raw_text"), [], DICTIONARY)
    return t.select("row_id", F.col("confidence").cast("long").alias("confidence"), "status")


@query(f"WITH {RECORDS} SELECT row_id, CASE WHEN strength <> '' THEN strength WHEN place % 2 = 0 THEN '8.8' ELSE '' END AS strength FROM records")
def signal_merge(spark, d):
    l = lines(spark, d).select("row_id", "raw_text", F.when(F.col("place") % 2 == 0, "8").otherwise("").alias("strength_raw"))
    return X.transform(l, ["strength"], DICTIONARY).select("row_id", "strength")


@query(f"WITH {RECORDS} SELECT row_id, trim(regexp_replace(item_type || ' ' || size || ' ' || din || ' ' || strength || ' ' || coating, '\\s+', ' ', 'g')) AS name FROM records")
def name_template(spark, d):
    fields = {c: F.col(c) for c in ("item_type", "size", "strength", "coating", "gost", "iso", "din")}
    named = lambda t: t.select("raw_text", T.render_name("{item_type} {size} {standard} {strength} {coating}", fields).alias("name"))
    return records(spark, d, named).select("row_id", "name")


READINESS = [R.Readiness("default", None, ("name", "qty"), 0), R.Readiness("bolt", "bolt", ("size", "strength"), 10), R.Readiness("ring", "ring", ("coating", "size"), 10)]


def _rows(spark, d):
    return records(spark, d).withColumn("qty", F.lit("1"))


_READY = """r AS (SELECT *, CASE item_type WHEN 'bolt' THEN CASE WHEN strength = '' THEN 'review' ELSE 'ok' END WHEN 'ring' THEN CASE WHEN coating = '' THEN 'review' ELSE 'ok' END ELSE 'ok' END AS readiness_status FROM records)"""


@query(f"WITH {RECORDS}, {_READY} SELECT row_id, readiness_status FROM r")
def readiness_status(spark, d):
    return R.readiness(_rows(spark, d), READINESS).select("row_id", "readiness_status")


VALIDATION = [R.Validation(item_type="plate", required=("coating",), force_status="manual"), R.Validation(item_type="gear", forbidden=("coating",), force_status="review")]


@query(f"""WITH {RECORDS}, {_READY} SELECT row_id, CASE WHEN item_type = 'plate' AND coating = '' THEN 'manual' WHEN item_type = 'gear' AND coating <> '' THEN 'review' ELSE readiness_status END AS status,
  CASE WHEN item_type = 'plate' AND coating = '' THEN 'отсутствует Покрытие' WHEN item_type = 'gear' AND coating <> '' THEN 'запрещено: Покрытие'
    WHEN readiness_status = 'review' AND item_type = 'bolt' THEN 'Не хватает: Класс прочности' WHEN readiness_status = 'review' THEN 'Не хватает: Покрытие' ELSE '' END AS reason FROM r""")
def validation_rules(spark, d):
    return R.evaluate(_rows(spark, d), READINESS, None, (), VALIDATION).select("row_id", "status", "reason")


_DIRECTORY = [("DIN", "931", "bolt"), ("DIN", "932", "ring")]


@query(f"WITH {RECORDS} SELECT row_id, CASE std_key WHEN 'DIN-931' THEN 'bolt' WHEN 'DIN-932' THEN 'ring' END AS standard_type, CASE WHEN std_key = 'DIN-931' THEN item_type <> 'bolt' WHEN std_key = 'DIN-932' THEN item_type <> 'ring' ELSE false END AS conflict FROM records")
def standards_enrich(spark, d):
    directory = spark.createDataFrame(_DIRECTORY, "kind string, code string, item_type string")
    return records(spark, d, lambda t: R.enrich(t, directory)).select("row_id", "standard_type", F.col("standard_conflict").isNotNull().alias("conflict"))


@query(f"WITH {RECORDS} SELECT row_id, CASE WHEN item_type = 'ring' THEN diameter WHEN item_type = 'bolt' THEN diameter || 'x' || length ELSE '' END AS size, CASE WHEN raw_text LIKE 'red%' AND item_type IN ('ring', 'bolt', 'rod') THEN 'red ' || item_type END AS item_subtype FROM records")
def inference_size(spark, d):
    own = [R.Inference("DIAMETER_AS_SIZE", ("ring",)), R.Inference("DIAMETER_X_LENGTH_AS_SIZE", ("bolt",))] + [R.Inference("KEYWORD_TO_ITEM_TYPE", (t,), "red", f"red {t}") for t in ("ring", "bolt", "rod")]
    return R.infer(records(spark, d).withColumn("size", F.lit("")), own).select("row_id", "size", "item_subtype")


_CATEGORIES = [R.Category(1, "metric_fasteners", None, "bolt_screw_stud", ("standard", "strength_class")), R.Category(2, "metric_fasteners", None, "nut", ("standard", "coating")), R.Category(3, "metric_fasteners", None, "washer", ("size", "load_capacity"))]
_EXCEPTIONS = [R.CategoryException(1, "болт", "DIN 933", ("standard",))]
_RUSSIAN = {"bolt": "болт", "ring": "гайка", "plate": "шайба"}


@query(f"""WITH {RECORDS} SELECT row_id, CASE WHEN item_type IN ('bolt', 'ring', 'plate') THEN 'metric_fasteners' END AS category,
  CASE item_type WHEN 'bolt' THEN CASE WHEN strength = '' AND std_key <> 'DIN-933' THEN 'needs_review' ELSE 'ok' END WHEN 'ring' THEN CASE WHEN coating = '' THEN 'needs_review' ELSE 'ok' END WHEN 'plate' THEN 'needs_review' END AS category_status FROM records""")
def category_rule(spark, d):
    r = records(spark, d).withColumn("item_type", F.coalesce(T.lookup(_RUSSIAN, F.col("item_type")), F.col("item_type")))
    return R.category_status(R.categorize(r), _CATEGORIES, _EXCEPTIONS).select("row_id", "category", "category_status")


@query(f"""WITH {RECORDS}, {_READY} SELECT row_id, 'status' AS "column", readiness_status AS before, CASE WHEN item_type = 'rod' THEN 'manual' ELSE readiness_status END AS after FROM r WHERE item_type = 'rod'""")
def rule_ab_diff(spark, d):
    def changes(texts):
        rows = texts.withColumn("qty", F.lit("1"))
        before, after = R.evaluate(rows, READINESS), R.evaluate(rows, [*READINESS, R.Readiness("rod", "rod", ("uom",), 20)])
        return snapshot.diff(before, after, "raw_text", ["status", "item_type", "size"])

    # A text's rows have its differences: both sides are judged and compared once a text.
    own = lines(spark, d).select("row_id", "raw_text")
    texts = X.line_record(own.select("raw_text").distinct(), DICTIONARY).withColumn("name", F.col("raw_text"))
    return own.join(changes(saved(texts)), "raw_text").drop("raw_text")


def _any(words):
    return "|".join(w.replace(".", "[.]") for w in words)


_ITEM = "|".join(V.ITEM_WORDS)


@query(rf"""WITH l AS (SELECT trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM conversations),
w AS (SELECT line, lower(line) AS low, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) AS words,
  regexp_matches(line, '(?i)(^|\s|/)(M\s*[0-9]+|[Мм][Мм]?\s*[0-9]+|[0-9]+([.,][0-9]+)?[xх×][0-9]+|[dдД]\s*[0-9]+|[0-9]+\s*мм)')
  OR regexp_matches(line, '(?i)(^|[^\pL\pN_])(DIN|ГОСТ\s*Р?\s*(ИСО)?|GOST|ISO|EN\s*[0-9]|ТУ)\s*[-\s]?[0-9]') OR regexp_matches(line, '(?i)(^|[^\pL\pN_])({_ITEM})([^\pL\pN_]|$)') AS item FROM l)
SELECT CASE WHEN line = '' THEN 'garbage' WHEN item THEN 'item' WHEN words <= 1 THEN 'garbage' WHEN regexp_matches(low, '{_any(V.TOTAL_WORDS)}') THEN 'total'
    WHEN {' + '.join(f"contains(low, '{w}')::INT" for w in V.HEADER_WORDS)} >= 3 THEN 'header' WHEN regexp_matches(low, '{_any(V.REQUISITE_WORDS)}') THEN 'requisites'
    WHEN regexp_matches(low, '{_any(V.DATE_WORDS)}') THEN 'requisites' WHEN regexp_matches(low, '{_any(V.TAX_WORDS)}') THEN 'total' WHEN words <= 2 THEN 'garbage' ELSE 'item' END AS line_class, count(*)::BIGINT AS n
FROM w GROUP BY 1""")
def line_classifier(spark, d):
    l = table(spark, d, "conversations").select(F.explode(F.split(T.text("text"), "\n")).alias("line"))
    return l.groupBy(X.classify_line("line").alias("line_class")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT order_id, count(*)::BIGINT AS n, sum(regexp_extract(raw_text, '([0-9]+) pcs$', 1)::INT)::DOUBLE AS qty FROM lines GROUP BY order_id")
def text_to_rows(spark, d):
    docs = lines(spark, d).groupBy("order_id").agg(F.array_join(F.sort_array(F.collect_list("raw_text")), "\n").alias("text"))
    rows = readers.text_rows(docs, "order_id", "text")
    return rows.groupBy("order_id").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query(f"WITH {LINES} SELECT order_id, count(*)::BIGINT AS n, sum(regexp_extract(raw_text, '([0-9]+) pcs$', 1)::INT)::DOUBLE AS qty FROM lines GROUP BY order_id")
def structured_list(spark, d):
    docs = lines(spark, d).groupBy("order_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("raw_text")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n").alias("text"))
    return readers.list_rows(docs, "order_id", "text").groupBy("order_id").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))
