"""Queries of readers, column profiles, recognised documents and sinks, over files and grids made from the driver's tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import vocab as V
from tallyforge.operators import catalog
from tallyforge.operators.graph import shared_dir, ship
from tallyforge.plans.base import dealt, register, table
from tallyforge.plans.scalars import case
from tallyforge.sources import profile, readers, sinks

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


def folder(spark) -> str:
    """A new folder beside the intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


# Delimited files


def _quotes(spark, d):
    return table(spark, d, "part").select("p_partkey", *[F.expr(e).alias(c) for c, e in {
        "name": "p_partkey || ' ' || " + case("p_name || ', red'", "'\"' || p_name || '\"; M8'", "p_name || CHR(10) || 'second line'", "''", "p_name"), "qty": "(p_size || ',5')", "unit": case("'шт'", "''", "'кг'")}.items()])


@query(f"""SELECT p_partkey, p_partkey || ' ' || {case("p_name || ', red'", "'\"' || p_name || '\"; M8'", "p_name || chr(10) || 'second line'", "''", "p_name")} AS name, p_size + 0.5::DOUBLE AS qty, {case("'шт'", "NULL", "'кг'")} AS unit FROM part WHERE p_partkey % 5 <> 3
UNION ALL SELECT p_partkey, p_partkey::VARCHAR, p_size + 0.5::DOUBLE, {case("'шт'", "NULL", "'кг'")} FROM part WHERE p_partkey % 5 = 3""")
def delimited_files(spark, d):
    """Client lines of a quoted file: names that hold delimiters, quotes and line breaks; commas as decimal points."""
    to = folder(spark)
    rows = _quotes(spark, d).select(F.col("name").alias("Наименование"), F.col("qty").alias("Кол-во"), F.col("unit").alias("Ед."))
    rows.coalesce(1).write.options(header=True, sep=";", quote='"', escape='"', quoteAll=True).csv(to)
    got = readers.client_rows(readers.read_delimited(spark, to))
    return got.select(F.regexp_extract("name", r"^\d+", 0).cast("long").alias("p_partkey"), "name", "qty", "unit")


def _sheet(rows: Iterable[list[str]], merge: str = "") -> Iterator[str]:
    """The parts of a sheet's XML; {} of merge is its last row."""
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    yield '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    count = 0
    for count, row in enumerate(rows, 1):
        yield f'<row r="{count}">' + "".join(cell(count, c, v) for c, v in enumerate(row) if v) + "</row>"
    merged = f'<mergeCells><mergeCell ref="{merge.format(count)}"/></mergeCells>' if merge else ""
    yield f'</sheetData>{merged}</worksheet>'


def _workbook(rows: Iterable[list[str]]) -> bytes:
    """A workbook of two sheets, the second of them active, with its first two cells of the last row merged."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="notes" sheetId="1"/><sheet name="goods" sheetId="2"/></sheets></workbook>')
        for k, parts in ((1, _sheet([["not", "these"]])), (2, _sheet(chain(rows, [["total", "", "end"]]), "A{0}:B{0}"))):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as part:
                for x in parts:
                    part.write(x.encode())
    return out.getvalue()


@query("""WITH p AS (SELECT *, 'book ' || p_partkey % 7 AS file, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) - 1 AS r FROM part)
SELECT file, r::BIGINT AS row_index, p_partkey || '|' || p_name || '|' || p_size AS cells FROM p UNION ALL SELECT file, count(*), 'total|total|end' FROM p GROUP BY file""")
def workbooks(spark, d):
    """The active sheets of workbooks, with merged cells."""
    def made(batches):
        for b in batches:
            for path, rows in zip(b.column(0), b.column(1)):
                book = _workbook(list(r.as_py().values()) for r in rows.values)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array([book], pa.binary())], ["path", "content"])

    ship(spark)
    p = table(spark, d, "part").groupBy(F.concat(F.lit("book "), (F.col("p_partkey") % 7).cast("string")).alias("path")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("rows"))
    p = p.select("path", F.transform("rows", lambda r: F.struct(r["p_partkey"].cast("string").alias("k"), r["p_name"].alias("n"), r["p_size"].cast("string").alias("z"))).alias("rows"))
    got = readers.workbook_rows(dealt(p).mapInArrow(made, "path string, content binary"))
    return got.where("sheet = 'goods'").select("file", F.col("row_index").cast("long").alias("row_index"), F.array_join("cells", "|").alias("cells"))


# Free text


@query(f"""WITH x AS (SELECT p_partkey AS k, p_name AS n FROM part)
SELECT k, 1::BIGINT AS row_number, n || ' M8' AS name, 5.0::DOUBLE AS qty, 'шт' AS uom, 'из текста' AS source, 'Примечание: ' || n || '; Все новое' AS note FROM x
UNION ALL SELECT k, 2, n || ' DIN 933', 12000.0, 'кг', 'из текста', 'Примечание: ' || n || '; Все новое' FROM x
UNION ALL SELECT k, 3, n, 7.0, 'шт', '{V.FROM_NAME}', 'Примечание: ' || n || '; Все новое' FROM x
UNION ALL SELECT k, 4, 'plus ' || n, NULL, NULL, '{V.NOT_FOUND}', 'Примечание: ' || n || '; Все новое' FROM x""")
def free_text(spark, d):
    """Order rows of free texts: numbered, with a dash, with a quantity on the next line, and service lines as notes."""
    text = F.expr("concat('1. ', p_name, ' M8 - 5 шт\n\n', p_name, ' DIN 933\nКол-во: 3 шт\nКоличество: 12 000 кг\nПримечание: ', p_name, '\r\n2) ', p_name, ' 7 шт\nВсе новое\nplus ', p_name)")
    got = readers.text_rows(table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.alias("text")), "k", "text")
    return got.select("k", F.col("row_number").cast("long").alias("row_number"), "name", "qty", "uom", F.col("qty_uom_source").alias("source"), F.col("note_raw").alias("note"))


@query("SELECT p_partkey, len(string_split(p_name, ' '))::BIGINT + 1 AS n, p_name || ' ' || p_size AS first, 'end ' || p_partkey AS last, CASE WHEN length(p_name) + p_size >= 50 THEN 'TEXT_PDF' ELSE 'SCAN_PDF' END AS kind FROM part")
def placed_words(spark, d):
    """Lines of placed words by gaps, lines of recognised words by their place, and pages with and without text."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.split("p_name", " ").alias("w"), "p_name")
    end = F.array(F.struct(F.lit(100.0).alias("y"), F.lit(1.0).alias("x"), F.lit("end").alias("word")), F.struct(F.lit(103.0).alias("y"), F.lit(90.0).alias("x"), F.col("p_partkey").cast("string").alias("word")))
    own = F.transform("w", lambda x, i: F.struct((i * 2.0).cast("double").alias("y"), (i * 10.0).cast("double").alias("x"), x.alias("word")))
    size = F.array(F.struct((F.size("w") * 2.0).cast("double").alias("y"), F.lit(900.0).alias("x"), F.col("p_size").cast("string").alias("word")))
    words = p.select(F.col("p_partkey").alias("page"), F.explode(F.concat(own, size, end)).alias("v")).select("page", "v.*")
    rows = readers.word_rows(words).groupBy("page").agg(F.min_by(F.array_join("cells", " "), "line").alias("first"), F.max(F.when(F.col("line") == 0, F.size("cells"))).alias("n"))
    seen = words.select("page", F.lit(1).alias("block"), F.lit(1).alias("par"), (F.col("y") >= 100).cast("int").alias("line"), F.col("x").cast("int").alias("left"), F.col("word").alias("text"))
    last = readers.grouped_words(seen).where("line = 1").select("page", F.col("line_text").alias("last"))
    texts = p.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("page"), F.col("p_name").alias("text")), F.struct(F.lit(2).alias("page"), F.expr("repeat('x', p_size) || '  '").alias("text")), F.struct(F.lit(3).alias("page"), F.expr("repeat('y', 99)").alias("text")))).alias("v")).select("doc_id", "v.*")
    kinds = readers.pdf_kind(texts).select(F.col("doc_id").alias("page"), "kind")
    return rows.join(last, "page").join(kinds, "page").select(F.col("page").alias("p_partkey"), F.col("n").cast("long").alias("n"), "first", "last", "kind")


@query(r"""SELECT doc_id, sha256(coalesce(text, '')) AS content, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')) END::BIGINT AS lines FROM documents""")
def wrapped_inputs(spark, d):
    """Files in base64, and benchmark inputs as JSON lists or lines."""
    t = table(spark, d, "documents").select("doc_id", F.base64(F.encode(T.text("text"), "UTF-8")).alias("content_base64"), F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array(T.text("text"), F.lit("x")))).otherwise(F.col("text")).alias("input_data"))
    got = readers.case_lines(readers.unwrapped(t))
    return got.select("doc_id", F.sha2("content", 256).alias("content"), F.size("lines").cast("long").alias("lines"))


# Recognised documents: every cell is 20 characters of the text.

_WIDE = 20


def _recognised(spark, d):
    """Suppliers' documents of two tables, paragraphs, lines and blocks, as JSON."""
    at = lambda i, sure=0.5: F.struct(F.struct(F.struct(F.array(F.struct(F.lit(str(i * _WIDE)).alias("startIndex"), F.lit(str((i + 1) * _WIDE)).alias("endIndex"))).alias("textSegments")).alias("textAnchor"), F.lit(sure).alias("confidence")).alias("layout"))
    k = "s_suppkey"
    words = ["'Наименование'", "'Кол-во'", "'Ед.'", "'Цена'", "'Сумма'", f"'Болт M' || {k}", "'2,5'", "'шт'", "'10'", "'25'", "'Гайка M8'", f"{k} || ''", "''", "'1 000'", "'x'", "'ИТОГО'", "''", "''", "''", "'125'", "'note'", "'one'",
             f"'Болт M8 ' || {k} || ' шт'", "'Спасибо'", "'Шайба DIN 125 3 кг'"]
    text = F.concat(*[F.rpad(F.expr(w), _WIDE, " ") for w in words])
    row = lambda *cells: F.struct(F.array(*[at(c) for c in cells]).alias("cells"))
    # By kind: 0 both tables, 1 only the plain one, 2 and 3 none; of 2 the paragraphs, of 3 the lines.
    product = F.struct(F.array(row(0, 1, 2, 3, 4)).alias("headerRows"), F.array(row(5, 6, 7, 8, 9), row(10, 11, 12, 13, 14), row(15, 16, 17, 18, 19)).alias("bodyRows"))
    plain = F.struct(F.array(row(20, 21)).alias("headerRows"), F.array(*[row(20, 6)] * 9).alias("bodyRows"))
    kind = F.col(k) % 4
    tables = F.when(kind == 0, F.array(plain, product)).when(kind == 1, F.array(plain))
    parts = F.when(kind == 2, F.array(at(22), at(23), at(24)))
    own = F.when(kind == 3, F.array(at(23), at(20)))
    page = F.struct(tables.alias("tables"), parts.alias("paragraphs"), own.alias("lines"), F.when(kind != 3, F.array(at(0, 0.9), at(1, 0.85), at(2, 0.813))).alias("blocks"))
    return table(spark, d, "supplier").select(F.col(k).alias("doc_id"), F.to_json(F.struct(text.alias("text"), F.array(page).alias("pages"))).alias("json"))


@query("""SELECT s_suppkey AS doc_id, r.row_no::BIGINT AS row_no, CASE r.row_no WHEN 0 THEN 'Болт M' || s_suppkey ELSE 'Гайка M8' END AS name, CASE r.row_no WHEN 0 THEN 2.5 ELSE s_suppkey END::DOUBLE AS qty,
  CASE r.row_no WHEN 0 THEN 'шт' END AS unit, CASE r.row_no WHEN 0 THEN 10 ELSE 1000 END::DOUBLE AS price_unit, CASE r.row_no WHEN 0 THEN 25 END::DOUBLE AS price_total
FROM supplier, (VALUES (0), (1)) AS r(row_no) WHERE s_suppkey % 4 = 0""")
def recognised_rows(spark, d):
    """Rows of product tables by their columns' roles, without summary rows."""
    tables = readers.best_tables(readers.ocr_tables(_recognised(spark, d)))
    return readers.structured_rows(tables).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "name", "qty", "unit", "price_unit", "price_total")


@query("""SELECT s_suppkey AS doc_id, t.no::BIGINT AS table_no, CASE t.no WHEN 1 THEN 4 ELSE 10 END::BIGINT AS n_rows, CASE t.no WHEN 1 THEN 4 * 16 / 20.0 + 0.2 ELSE 10.2 END::DOUBLE AS score, CASE t.no WHEN 1 THEN 'Наименование|Кол-во|Ед.|Цена|Сумма' ELSE 'note|one' END AS header
FROM supplier, (VALUES (0), (1)) AS t(no) WHERE s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 AND t.no = 0""")
def recognised_tables(spark, d):
    """All tables of recognised documents as grids, with their scores."""
    t = readers.ocr_tables(_recognised(spark, d)).withColumn("score", F.round(readers.table_score(), 6))
    return t.select("doc_id", F.col("table_no").cast("long").alias("table_no"), F.col("n_rows").cast("long").alias("n_rows"), "score", F.array_join(F.flatten("header"), "|").alias("header"))


@query("""SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'product_table' WHEN 1 THEN 'table' WHEN 2 THEN 'paragraph' ELSE 'line' END AS mode, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 10 ELSE 2 END::BIGINT AS n,
  CASE s_suppkey % 4 WHEN 0 THEN 'Болт M' || s_suppkey || '|2,5|шт|10|25' WHEN 1 THEN 'note|one' WHEN 2 THEN 'Болт M8 ' || s_suppkey || ' шт' ELSE 'Спасибо' END AS first FROM supplier""")
def recognised_documents(spark, d):
    """What is taken of each document: a product table, else the best table, else paragraphs, else lines."""
    got = readers.extract_document(_recognised(spark, d))
    return got.groupBy("doc_id", "mode").agg(F.count("*").alias("n"), F.min_by(F.array_join("cells", "|"), "row_no").alias("first"))


@query("""SELECT s_suppkey AS doc_id, NULL::VARCHAR AS line, CASE WHEN s_suppkey % 4 <> 3 THEN 85.4 END::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 4 <> 2
UNION ALL SELECT s_suppkey, 'Болт M8 ' || s_suppkey || ' шт', 85.4 FROM supplier WHERE s_suppkey % 4 = 2 UNION ALL SELECT s_suppkey, 'Шайба DIN 125 3 кг', 85.4 FROM supplier WHERE s_suppkey % 4 = 2""")
def recognised_lines(spark, d):
    """Paragraphs that look like goods with a quantity, and the mean confidence."""
    docs = _recognised(spark, d)
    return readers.ocr_confidence(docs).join(readers.ocr_lines(docs).select("doc_id", "line"), "doc_id", "left").select("doc_id", "line", "confidence")


# Column profiles

_HEAD = ["№", "Наименование товара", "Кол-во, шт", "Артикул", "Прочее"]
_BODY = ["p_partkey + 1 || ''", "p_name || ' DIN ' || (931 + p_partkey % 4)", "p_size || ''", "'A-' || p_partkey", case("'x'", "''", "'note'")]


def _grid(spark, d, header: bool = True):
    rows = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("row_index"), F.array(*[F.expr(c) for c in _BODY]).alias("cells"))
    head = spark.createDataFrame([(0, _HEAD)], "row_index long, cells array<string>")
    return rows.unionByName(head) if header else rows


_LONG = "v AS (" + " UNION ALL ".join(f"SELECT {i} AS col, p_partkey AS k, trim({c}) AS v FROM part WHERE trim({c}) <> ''" for i, c in enumerate(_BODY)) + ")"
_SCORES = _LONG + r""", f AS (SELECT col, count(*) AS n, avg(length(v)) AS len, avg(regexp_matches(v, '[a-zA-Z]')::INT) AS alpha, avg(regexp_matches(v, 'DIN\s*\d+')::INT) AS goods, avg(regexp_matches(v, '^\d+$')::INT) AS num, 0.0 AS qu, 0.0 AS size,
  avg((length(v) <= 15)::INT) AS s15, avg((length(v) <= 8)::INT) AS s8, avg(regexp_matches(v, '^[A-Za-z0-9_./-]{1,20}$')::INT) AS code, count(try_cast(v AS DOUBLE)) AS numbers, avg(try_cast(v AS DOUBLE)) AS mean FROM v GROUP BY 1),
c AS (SELECT *, least(1, greatest(0, alpha * 0.35 + least(len / 25, 1) * 0.25 + goods * 0.25 + (1 - num) * 0.1 - qu * 0.1 + size * 0.1)) AS name_score, least(1, greatest(0, qu * 0.6 + num * 0.25 + (1 - least(len / 20, 1)) * 0.1 - goods * 0.15)) AS qty_score,
  least(1, greatest(0, code * 0.45 + s15 * 0.25 - goods * 0.1 + (1 - least(len / 15, 1)) * 0.1)) AS code_score, least(1, greatest(0, s8 * 0.2 - num * 0.1 - goods * 0.1)) AS uom_score FROM f)"""


@query(f"WITH {_SCORES} SELECT col::BIGINT AS col, n, round(name_score, 6) AS name_score, round(qty_score, 6) AS qty_score, round(code_score, 6) AS code_score, round(uom_score, 6) AS uom_score FROM c")
def column_scores(spark, d):
    """How well each column serves as name, quantity, code and unit, by its cells alone."""
    f = profile.column_features(_grid(spark, d, False))
    return f.select(F.col("col").cast("long").alias("col"), "n", *[F.round(c, 6).alias(c) for c in ("name_score", "qty_score", "code_score", "uom_score")])


_RISING = "r AS (SELECT col, bool_and(v ~ '^[0-9]+$') AND count(*) FILTER (WHERE x <= b) <= 0.1 * (count(*) - 1) AS is_index FROM (SELECT col, v, try_cast(v AS DOUBLE) AS x, lag(try_cast(v AS DOUBLE)) OVER (PARTITION BY col ORDER BY k) AS b FROM v) GROUP BY 1)"


@query(f"""WITH {_SCORES}, {_RISING}, nm AS (SELECT col FROM c ORDER BY name_score DESC, col LIMIT 1), q AS (SELECT col, qty_score FROM c WHERE qty_score > 0.15 AND col NOT IN (SELECT col FROM nm) AND col NOT IN (SELECT col FROM r WHERE is_index) ORDER BY qty_score DESC, col LIMIT 1),
u AS (SELECT col FROM c WHERE uom_score > 0.5 AND col NOT IN (SELECT col FROM nm UNION SELECT col FROM q) AND col NOT IN (SELECT col FROM r WHERE is_index) ORDER BY uom_score DESC, col LIMIT 1),
k AS (SELECT col FROM c WHERE code_score > 0.25 AND col NOT IN (SELECT col FROM nm UNION SELECT col FROM q UNION SELECT col FROM u) AND col NOT IN (SELECT col FROM r WHERE is_index) ORDER BY code_score DESC, col LIMIT 1)
SELECT (SELECT col FROM nm)::BIGINT AS name, (SELECT col FROM q)::BIGINT AS qty, (SELECT col FROM u)::BIGINT AS uom, (SELECT col FROM k)::BIGINT AS code, (SELECT string_agg(col::VARCHAR, ',' ORDER BY col) FROM r WHERE is_index) AS indexes,
  round((SELECT max(name_score) FROM c) * 0.65 + coalesce((SELECT qty_score FROM q), 0) * 0.35, 3) AS confidence""")
def scored_columns(spark, d):
    """Roles by content alone: greedily, without columns of row numbers."""
    c = profile.score_columns(_grid(spark, d, False), 0)
    return spark.createDataFrame([(c.name, c.qty, c.uom, c.code, ",".join(map(str, c.index)), c.confidence)], "name long, qty long, uom long, code long, indexes string, confidence double")


_WORDS = ", ".join(f"('{r}', '{w}')" for r, ws in (("name", profile.NAME_SYNONYMS), ("qty", profile.QTY_SYNONYMS), ("code", profile.CODE_SYNONYMS), ("uom", profile.UOM_SYNONYMS)) for w in ws)
_HEADS = ", ".join(f"({i}, '{h.lower()}')" for i, h in enumerate(_HEAD))


@query(f"""WITH h(col, t) AS (VALUES {_HEADS}), s(role, word) AS (VALUES {_WORDS}), m AS (SELECT role, min(col) AS col FROM h JOIN s ON contains(t, word) GROUP BY role)
SELECT 0::BIGINT AS header, 3::BIGINT AS score, (SELECT col FROM m WHERE role = 'name')::BIGINT AS name, (SELECT col FROM m WHERE role = 'qty')::BIGINT AS qty, (SELECT col FROM m WHERE role = 'code')::BIGINT AS code,
  (SELECT regexp_extract(t, '[ ,]+(шт)$', 1) FROM h WHERE col = (SELECT col FROM m WHERE role = 'qty')) AS header_uom""")
def detected_columns(spark, d):
    """The header's row, how much of a header it is, and the columns that it names."""
    grid = _grid(spark, d)
    at, score = profile.header_row(profile.head(grid))
    c = profile.detect_columns(grid)
    return spark.createDataFrame([(at, score, c.name, c.qty, c.code, c.header_uom)], "header long, score long, name long, qty long, code long, header_uom string")


@query(f"""SELECT p_partkey + 1 AS row_id, 'A-' || p_partkey AS code, p_name || ' DIN ' || (931 + p_partkey % 4) AS name, p_size::DOUBLE AS qty, 'шт' AS uom, '{V.FROM_HEADER}' AS source,
  p_name || ' DIN ' || (931 + p_partkey % 4) || ' | ' || p_size || CASE WHEN p_partkey + 1 = p_size THEN '' ELSE ' | ' || (p_partkey + 1) END || {case("' | x'", "''", "' | note'")} AS raw_text FROM part""")
def request_rows(spark, d):
    """Rows of a grid whose columns were found by its header."""
    got = profile.load_grid(_grid(spark, d))
    return got.select("row_id", "code", "name", "qty", "uom", F.col("qty_uom_source").alias("source"), "raw_text")


@query(f"""SELECT p_partkey + 1 AS row_id, p_name AS name, {case("5.0", "p_size", "NULL", "8.0")}::DOUBLE AS qty, {case("'шт'", "'кг'", "NULL", "'м'")} AS uom, {case(f"'{V.FROM_JOINED}'", f"'{V.FROM_UNIT_COLUMN}'", f"'{V.NOT_FOUND}'", f"'{V.FROM_NAME}'")} AS source FROM part""")
def joined_rows(spark, d):
    """Rows whose quantity is in a cell of no role, in cells of its own, nowhere, or in the name."""
    cells = [case("p_name", "p_name", "p_name", "p_name || ' 8 м'"), case("''", "p_size || ''", "''", "''"), case("''", "'кг'", "'кг'", "''"), case("'for you 5 шт'", "'x'", "'y'", "'z'")]
    grid = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("row_index"), F.array(*[F.expr(c) for c in cells]).alias("cells"))
    got = profile.request_frame(grid, profile.Columns(name=0, qty=1, uom=2, header=0))
    return got.select("row_id", "name", "qty", "uom", F.col("qty_uom_source").alias("source"))


@query("""WITH c AS (SELECT n_nationkey AS k, n_name AS a, n_regionkey::VARCHAR AS b FROM nation), m AS (SELECT *, (length(a) + length(b)) / 2 AS len FROM c)
SELECT k::BIGINT AS k, round(least(1, greatest(0, 0.5 - 0.30 * 0.5 + CASE WHEN len < 15 THEN 0.08 WHEN len > 40 THEN -0.15 ELSE 0 END)), 4)::DOUBLE AS plain,
  round(least(1, greatest(0, 0.5 + 0.05 + 0.40 + 0.08 + 0.07)), 4)::DOUBLE AS marked, round(least(1, greatest(0, 0.5 - 0.55 + 0.08)), 4)::DOUBLE AS data FROM m""")
def header_confidence(spark, d):
    """How sure a recognised table's first row is its header: names of nations, words of headers, signs of data."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("r")).collect()  # 25
    out = [(r["n_nationkey"], profile.header_confidence([[r["n_name"], r["r"]]]), profile.header_confidence([["Наименование", "Цена"], [r["n_name"], "5"], [r["n_name"], "7"]], True), profile.header_confidence([[f"М{r['n_nationkey']}", "DIN 933"]])) for r in rows]
    return spark.createDataFrame(out, "k long, plain double, marked double, data double")


@query("""WITH m AS (SELECT p_partkey AS k, p_name AS name, p_size AS z FROM part)
SELECT k AS row_id, name, z::DOUBLE AS qty, 'кг' AS uom, 'direct' AS source, 'A-' || k AS extra_0, '10,5' AS extra_4 FROM m""")
def recognised_columns(spark, d):
    """A recognised table's columns by cells and headers, and its rows with the columns that have no role."""
    grid = table(spark, d, "part").select(F.col("p_partkey").alias("row_index"), F.array(F.concat(F.lit("A-"), F.col("p_partkey").cast("string")), "p_name", F.col("p_size").cast("string"), F.lit("кг"), F.lit("10,5")).alias("cells"))
    c = profile.recognised_columns(grid, ["Код", "Описание", "Кол-во", "Ед.", "Сумма"])
    return profile.canonical_frame(grid, c, 5)


@query("SELECT p_partkey AS row_id, p_name AS name, p_size::DOUBLE AS qty, 'шт' AS uom, 'header_hint' AS source, 'кг' AS extra_2 FROM part")
def chosen_columns(spark, d):
    """A recognised table's rows by columns that a user chose, with the unit in the quantity's header."""
    grid = table(spark, d, "part").select(F.col("p_partkey").alias("row_index"), F.array("p_name", F.col("p_size").cast("string"), F.lit("кг")).alias("cells"))
    c = profile.recognised_columns(grid, ["x", "Кол-во, шт", "y"], {"name": 0, "qty": 1, "uom": None})
    return profile.canonical_frame(grid, c, 3)


_OFFERS = ["'Название', 'Цена без НДС', 'Ед. изм'", "'Артикул', 'Price ' || p_size, 'Unit'", "p_name, 'y', 'z'", "'Стоимость', 'Товар ' || p_name, 'Количество'"]


@query(f"""SELECT p_partkey AS offer, {case("1", "1", "NULL", "0")}::BIGINT AS price, {case("0", "0", "0", "1")}::BIGINT AS name, {case("2", "2", "NULL", "NULL")}::BIGINT AS unit,
  {case("p_name", "p_name", "p_name", "p_size || ''")} AS first_name FROM part""")
def offer_columns(spark, d):
    """Columns of price, name and unit by each part's offer's headers, and the name in its first row."""
    made = case(*[f"array({h})" for h in _OFFERS])
    row = F.array("p_name", F.col("p_size").cast("string"), F.lit("шт"))
    got = table(spark, d, "part").select("p_partkey", row.alias("row"), profile.offer_columns(F.expr(made)).alias("x"))
    return got.select(F.col("p_partkey").alias("offer"), *[F.col(f"x.{c}").cast("long").alias(c) for c in ("price", "name", "unit")], F.get("row", F.col("x.name")).alias("first_name"))


@query("""SELECT p_partkey + 1 AS row_index, p_name AS raw_text, p_size::DOUBLE AS qty, CASE WHEN p_partkey % 2 = 0 THEN 12.5 END::DOUBLE AS price, (p_partkey % 5)::DOUBLE AS total, 'шт' AS unit FROM part""")
def quote_wizard(spark, d):
    """Quote lines by the columns a user chose; numbers fall back to a cell's first number."""
    from tallyforge.operators import quotes

    cells = ["p_name", case("p_size || ''", "p_size || ' шт'", "'ok. ' || p_size"), case("'12,5'", "'-'"), "' ' || p_partkey % 5 || ' руб'", "' шт '"]
    grid = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("row_index"), F.array(*[F.expr(c) for c in cells]).alias("cells"))
    return quotes.wizard_rows(grid, {"name": 0, "qty": 1, "price": 2, "total": 3, "unit": 4}).select("row_index", "raw_text", "qty", "price", F.col("price_total").alias("total"), "unit")


# Sinks


@query("SELECT p_partkey AS k, p_name AS name, 'kept' AS meta FROM part")
def cached_tables(spark, d):
    """A table written with its meta data, and read again; the version in its path is that of its rows."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    to = f"{folder(spark)}/{catalog.snapshot_version(p)}"
    sinks.write_cached(p, to, {"state": "kept"})
    got, meta = sinks.read_cached(spark, to)
    assert to.endswith(catalog.snapshot_version(got))
    return got.withColumn("meta", F.lit(meta["state"]))


@query("SELECT p_partkey AS k, p_name AS name, p_size::BIGINT AS z, 'M' || p_size AS size FROM part")
def json_and_traces(spark, d):
    """Rows and their traces as JSON lines, read again."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.struct("p_partkey", F.struct(F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("size"), F.col("p_size").alias("z")).alias("extracted")).alias("trace"))
    plain, traces = folder(spark), folder(spark)
    sinks.write_json(p.drop("trace"), plain)
    sinks.write_trace(p, traces)
    t = spark.read.schema("p_partkey long, extracted struct<size:string,z:long>").json(traces)
    return spark.read.schema("k long, name string").json(plain).join(t.select(F.col("p_partkey").alias("k"), F.col("extracted.z").alias("z"), F.col("extracted.size").alias("size")), "k")


@query("SELECT p_partkey AS row_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_size || '.5' END AS qty, CASE WHEN p_partkey % 3 = 0 THEN 'AUTO_EXACT' END AS mode, CASE WHEN p_partkey % 3 = 0 THEN 100 END::BIGINT AS score FROM part WHERE p_partkey % 4 <> 1")
def exported_rows(spark, d):
    """The ok rows for export: without inner columns, with the match's mode and score, whole quantities as whole numbers; written as CSV and read again."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("row_id"), F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.5).alias("qty"), F.lit("x").alias("raw_text"), F.when(k % 4 == 1, "review").otherwise("ok").alias("status"))
    decisions = table(spark, d, "part").where("p_partkey % 3 = 0").select(k.alias("row_id"), F.lit("AUTO_EXACT").alias("mode"), F.lit(100).alias("score"), F.lit(1).alias("item_id"))
    to = folder(spark)
    sinks.write_csv(sinks.export_view(sinks.ok_rows(p), ["raw_text", "status", "absent"], decisions), to, mark=True)
    return spark.read.option("header", True).schema("row_id long, name string, qty string, mode string, score long").csv(to)


@query("SELECT * FROM (SELECT p_partkey AS row_id, p_name AS name FROM part ORDER BY p_partkey LIMIT 200)")
def preview(spark, d):
    return sinks.preview(table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name")))


@query("SELECT p_partkey AS item_id, 128::BIGINT AS n, true AS same FROM part")
def stored_signatures(spark, d):
    """Signatures written once for a version of the items, and read again while it lasts."""
    from tallyforge.operators import similarity as S

    i = dealt(table(spark, d, "part")).select(F.col("p_partkey").alias("item_id"), T.char_ngrams("p_name").alias("tokens"))
    to, version = folder(spark), catalog.snapshot_version(i.select("item_id"))
    sinks.signature_table(i, to, version)
    again = sinks.signature_table(i.where("false"), to, version)
    # The expression that they are held against is slow: it is made once for each different set, by all tasks.
    own = dealt(i.select("tokens").distinct()).select("tokens", S.signature(F.col("tokens")).alias("own"))
    return again.join(i, "item_id").join(own, "tokens").select("item_id", F.size("signature").cast("long").alias("n"), (F.col("signature") == F.col("own")).alias("same"))
