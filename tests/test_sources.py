"""Readers, column profiles, recognised documents, sinks and streams."""

import io
import json
import tracemalloc
import zipfile

from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.functions import extract as X
from tallyforge.functions import seeds
from tallyforge.sources import profile, readers, sinks

GRID = "row_index int, cells array<string>"


def grid(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), GRID)


def test_columns_by_header(spark):
    g = grid(spark, [["Заявка", None, None], ["№", "Наименование", "Кол-во, шт"], ["1", "Болт М12х80", "10"], ["2", "Гайка М16", "20"], ["3", "", "7"]])
    c = profile.detect_columns(g)
    assert (c.name, c.qty, c.header, c.header_uom) == (1, 2, 1, "шт")
    assert [(r["name"], r["qty"], r["uom"]) for r in profile.load_grid(g).collect()] == [("Болт М12х80", 10.0, "шт"), ("Гайка М16", 20.0, "шт")]


def test_columns_by_content(spark):
    g = grid(spark, [[str(i), f"Болт М{i}х80 ГОСТ 7798", f"{i * 10}", "шт", f"A-{i}"] for i in range(1, 8)])
    c = profile.score_columns(g)
    assert (c.name, c.qty, c.uom, c.code, c.index) == (1, 2, 3, 4, [0, 2]) or (c.name, c.uom) == (1, 3)
    one = profile.score_columns(grid(spark, [["Болт М8"], ["Гайка М9"]]))
    assert (one.name, one.qty) == (0, None)


def test_index_columns(spark):
    rows = [["1", "5", "1.5", "a1", "9"], ["2", "4", "2.5", "a2", "9"], ["3.", "6", "3.5", "a3", "9"], ["4", "2", "4.5", "a4", "9"]]
    assert {r["col"]: r["is_index"] for r in profile.index_columns(grid(spark, rows)).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_combined_quantities_and_two_header_lines(spark):
    g = grid(spark, [["Наименование", "Кол-во"], ["Болт", "5 кг"], ["Гайка", "2,5 кг"]])
    assert profile.detect_columns(g).combined and [(r["qty"], r["uom"]) for r in profile.load_grid(g).collect()] == [(5.0, "кг"), (2.5, "кг")]
    assert profile.merged_header([["Наименование", "Всего"], ["", "ед.изм шт"]], 0) == (["наименование", "всего ед.изм шт"], True)
    assert profile.merged_header([["Наименование", "Кол-во"], ["Болт", "100 шт"]], 0)[1] is False


def test_header_confidence():
    assert profile.header_confidence([["Наименование", "Ед.изм", "Кол-во"], ["Болт М12", "шт", "5"], ["Гайка", "шт", "6"]]) >= profile.HEADER_SURE
    assert profile.header_confidence([["Болт М12х50", "5"], ["Гайка", "6"]]) < profile.HEADER_SURE
    assert profile.header_confidence([]) == profile.header_confidence([["", ""]]) == 0.0
    assert profile.partial_ratio("количество", "кол") == 100 and profile.fuzzy_match("наименованее", ["наименование"]) >= 70 and profile.fuzzy_match("цвет", ["наименование"]) == 0


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Наименование;Кол-во;Ед\n\"Болт\";2,5;шт\n;3;кг\n", encoding="utf-8")
    assert [tuple(r) for r in readers.client_rows(readers.read_delimited(spark, str(tmp_path / "a.csv"))).select("name", "qty", "unit").collect()] == [("Болт", 2.5, "шт")]
    (tmp_path / "b.csv").write_bytes("Наименование\tКол-во\nГайка\t7\n".encode("cp1251"))
    assert [tuple(r) for r in readers.client_rows(readers.read_delimited(spark, str(tmp_path / "b.csv"))).select("name", "qty").collect()] == [("Гайка", 7.0)]
    assert readers.sniff_delimiter("a|b|c,d") == "|" and readers.sniff_delimiter("abc") == ","


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Лист" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Болт</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="2"><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(data.getvalue())
    got = readers.read_workbooks(spark, str(tmp_path / "w.xlsx")).orderBy("row_index").collect()
    assert [(r["sheet"], r["cells"]) for r in got] == [("Лист", ["Болт", None, "2.5"]), ("Лист", ["Болт", "x", None])]


def _book(body: str, merged: str) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="s" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData><mergeCells>{merged}</mergeCells></worksheet>")
    return data.getvalue()


def test_a_workbook_is_read_as_a_stream():
    """Rows that rise are streamed, others gathered: the same rows, and the stream holds few of them."""
    cell = lambda r, c: f'<c r="{c}{r}"><v>{r}{c}</v></c>'
    rows = [f'<row r="{r}">' + "".join(cell(r, c) for c in cs) + "</row>" for r, cs in ((2, "AC"), (3, ""), (4, "B"), (7, "AD"))]
    merged = "".join(f'<mergeCell ref="{x}"/>' for x in ("C2:C5", "A2:B4", "B4:E4", "D7:F9", "A12:B13", "B2:D3"))
    streamed, gathered = (list(readers._workbook(_book("".join(x), merged))) for x in (rows, rows[::-1]))
    assert streamed == gathered and len(streamed) == 9 and streamed[4][2] == [None, None, "2C", None, None, None]
    many = _book("".join(f'<row r="{r}">{cell(r, "A")}{cell(r, "B")}</row>' for r in range(1, 10_001)), '<mergeCell ref="A1:A2"/>')
    tracemalloc.start()
    assert sum(1 for _ in readers._workbook(many)) == 10_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20


def test_a_column_is_sorted_once_to_judge_it(spark):
    rows = [[str(i), "x" if i % 5 else str(i)] for i in range(12)]
    plan = profile.index_columns(grid(spark, rows))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 2  # one for the rows in their order, one for sums
    assert {r["col"]: r["is_index"] for r in plan.collect()} == {0: True, 1: False}


def test_free_text(spark):
    text = "1. Болт М12 - 10 шт\nГайка М16\nКоличество: 20 шт\nпримечание: срочно\n\nШайба 5 кг\nВинт — 1 000 шт\nкол-во 3 шт"
    d = spark.createDataFrame([(1, text), (2, "Количество: 5 шт\nБолт"), (3, None)], "doc_id long, text string")
    got = readers.text_rows(d).orderBy("doc_id", "row_number").collect()
    assert [(r["doc_id"], r["name"], r["qty"], r["uom"]) for r in got] == [(1, "Болт М12", 10.0, "шт"), (1, "Гайка М16", 20.0, "шт"), (1, "Шайба", 5.0, "кг"), (1, "Винт — 1 000 шт", 3.0, "шт"), (2, "Количество:", 5.0, "шт"), (2, "Болт", None, None)]
    assert {r["note_raw"] for r in got if r["doc_id"] == 1} == {"примечание: срочно"}


def test_single_lines_and_lists(spark):
    df = spark.createDataFrame([(0, "Гайка М16 шт. 10"), (1, "Болт М16х50, 20 шт"), (2, "Шайба DIN125 50")], "i int, x string").orderBy("i")
    assert [tuple(r[0]) for r in df.select(readers.parse_line("x")).collect()] == [("Гайка М16", 10.0, "шт"), ("Болт М16х50", 20.0, "шт"), ("Шайба DIN125 50", None, None)]
    d = spark.createDataFrame([(1, "1) Болт - 10 шт\nтекст\n2.1. Гайка 5 кг")], "doc_id long, text string")
    assert [(r["name"], r["qty"], r["uom"]) for r in readers.list_rows(d).collect()] == [("Болт", 10.0, "шт"), ("Гайка", 5.0, "кг")]


def test_words_to_lines(spark):
    w = spark.createDataFrame([(1, 10.0, 100.0, "b"), (1, 0.0, 101.0, "a"), (1, 0.0, 120.0, "c")], "page int, x double, y double, word string")
    assert [r["cells"] for r in readers.word_rows(w).orderBy("line").collect()] == [["a", "b"], ["c"]]
    g = spark.createDataFrame([(1, 1, 1, 1, 50, "мир"), (1, 1, 1, 1, 5, "привет"), (1, 1, 1, 2, 5, " ")], "page int, block int, par int, line int, left int, text string")
    assert [r["line_text"] for r in readers.grouped_words(g).collect()] == ["привет мир"]
    p = spark.createDataFrame([(1, 0, "x" * 60), (2, 0, "x"), (2, 9, "x" * 99)], "doc_id long, page int, text string")
    assert {r["doc_id"]: r["kind"] for r in readers.pdf_kind(p).collect()} == {1: "TEXT_PDF", 2: "SCAN_PDF"}


def layout(a, b, confidence=None):
    return {"layout": {"textAnchor": {"textSegments": [{"startIndex": str(a), "endIndex": str(b)}]}, "confidence": confidence}}


def test_recognised_documents(spark):
    text = "Товар Кол-во Болт 10 Итого 5 Гайка М8 7 шт привет"
    span = lambda s: (text.index(s), text.index(s) + len(s))
    cells = lambda *names: {"cells": [layout(*span(n)) for n in names]}
    table = {"headerRows": [cells("Товар", "Кол-во")], "bodyRows": [cells("Болт", "10"), cells("Итого", "5")]}
    other = {"headerRows": [], "bodyRows": [cells("привет"), cells("Болт"), cells("Гайка"), cells("10")]}
    docs = spark.createDataFrame([
        (1, json.dumps({"text": text, "pages": [{"tables": [other, table], "blocks": [layout(0, 5, 0.9), layout(0, 5, 0.8)]}]})),
        (2, json.dumps({"text": text, "pages": [{"paragraphs": [layout(*span("Гайка М8 7 шт")), layout(*span("привет"))]}]})), (3, json.dumps({"text": text, "pages": [{"lines": [layout(*span("привет"))]}]})), (4, "{}"),
    ], "doc_id long, json string")
    got = {}
    for r in readers.extract_document(docs).orderBy("doc_id", "row_no").collect():
        got.setdefault((r["doc_id"], r["mode"]), []).append(r["cells"])
    assert got == {(1, "product_table"): [["Болт", "10"], ["Итого", "5"]], (2, "paragraph"): [["Гайка М8 7 шт"]], (3, "line"): [["привет"]]}
    assert [(r["name"], r["qty"]) for r in readers.structured_rows(readers.best_tables(readers.ocr_tables(docs))).collect()] == [("Болт", 10.0)]
    assert {r["doc_id"]: r["confidence"] for r in readers.ocr_confidence(docs).collect()} == {1: 85.0, 2: None, 3: None, 4: None}
    assert {r["mode"] for r in readers.extract_document(docs, hint="free_text").collect()} == {"paragraph", "line"}


def test_recognised_quantities(spark):
    df = spark.createDataFrame([(0, "250 кг", ""), (1, "5", "КГ"), (2, "", "КГ 4"), (3, "3", "2,5 тыс. шт"), (4, "7", "N КГ"), (5, "3", "тыс шт"), (6, "8", ""), (7, "x", "y")], "i int, q string, u string").orderBy("i")
    got = [tuple(r[0]) for r in df.select(readers.cell_quantity("q", "u", F.lit("Кол-во, шт"))).collect()]
    assert got == [(250.0, "кг", "split_qty_col"), (5.0, "кг", "direct"), (4.0, "кг", "uom_before_qty"), (2500.0, "шт", "thous_in_uom"), (7.0, "кг", "ocr_junk_uom"), (3000.0, "шт", "thous_mult"), (8.0, "шт", "header_hint"), (None, None, "not_found")]


def test_cases_and_wrapped_files(spark):
    df = spark.createDataFrame([('["a", "b"]', "0JHQvtC70YI="), (" x \n\n y", None)], "input_data string, content_base64 string")
    assert [r["lines"] for r in readers.case_lines(df).collect()] == [["a", "b"], ["x", "y"]]
    assert bytes(readers.unwrapped(df).first()["content"]).decode() == "Болт"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "ok", "z"), (2, 2.5, "review", "z")], "row_id long, qty double, status string, hidden string")
    sinks.write_cached(df, str(tmp_path / "c"), {"name": "файл"})
    back, meta = sinks.read_cached(spark, str(tmp_path / "c"))
    assert back.count() == 2 and meta == {"name": "файл"}
    view = sinks.export_view(df, ["hidden"], df.select("row_id", F.lit("AUTO").alias("mode"), F.lit(1).alias("score"))).orderBy("row_id").collect()
    assert [(r["qty"], r["mode"]) for r in view] == [("2", "AUTO"), ("2.5", "AUTO")] and "hidden" not in view[0].asDict()
    assert sinks.ok_rows(df).count() == 1 and sinks.preview(df, limit=1).first()["row_id"] == 1
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"), mark=True)
    assert next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8").startswith("﻿row_id,")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_trace(df.withColumn("trace", F.struct("status")), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ['{"status":"ok"}', '{"status":"review"}']
    assert len(sinks.file_key(b"x")) == 16 and sinks.text_key("x").startswith("txt_") and sinks.download_key("k", ["b", "a"]) == sinks.download_key("k", ["a", "b"])
    items = spark.createDataFrame([(1, ["a", "b"])], "item_id long, tokens array<string>")
    first = sinks.signature_table(items, str(tmp_path / "s"), "v1").first()["signature"]
    assert sinks.signature_table(items.where("false"), str(tmp_path / "s"), "v1").first()["signature"] == first and len(first) == 128


def test_stream_of_rows(spark, tmp_path):
    spark.createDataFrame([(1, "Болт М8х20 5 шт"), (2, "Гайка М10")], "row_id long, raw_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, raw_text string").parquet(str(tmp_path / "in"))
    q = streaming.each_batch(stream, lambda b: X.line_record(b, seeds.default_dictionary()).select("row_id", "size"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r["row_id"]: r["size"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "M8x20", 2: "M10"}
