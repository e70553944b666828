"""Scalar functions on texts as they come in orders."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T


@pytest.fixture
def value(spark):
    def compute(function, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [r["y"] for r in rows]

    return compute


def test_tail_quantity(value):
    got = value(T.tail_quantity, "Болт М12 10 тыс. шт.", "Гайка 250кг", "Винт 2,5 кг", "Шуруп 5 вагон", "Болт М12", "", None, "Шайба 7 тыс. ящиков", "Гвозди 3 pcs")
    assert [(r["clean"], r["qty"], r["uom"], r["multiplier"]) for r in got] == [
        ("Болт М12", 10000.0, "шт", 1000), ("Гайка", 250.0, "кг", 1), ("Винт", 2.5, "кг", 1), ("Шуруп 5 вагон", None, None, 1), ("Болт М12", None, None, 1), ("", None, None, 1), ("", None, None, 1),
        ("Шайба 7 тыс. ящиков", None, None, 1), ("Гвозди", 3.0, "шт", 1),
    ]
    assert [bool(r["reason"]) for r in got] == [False, False, False, True, False, False, False, True, False]


def test_quantity_anywhere_and_at_the_end(value):
    assert [tuple(r) for r in value(T.parse_qty_uom, "(200 шт)", "Болт (200 шт.) оц", "12 кг болтов", "без")] == [(200.0, "шт", ""), (200.0, "шт", "Болт оц"), (12.0, "кг", "болтов"), (None, None, "без")]
    assert [tuple(r) for r in value(T.qty_uom_suffix, "Болт (20 шт)", "Болт 20 шт.", "20 шт болт")] == [(20.0, "шт", "Болт"), (20.0, "шт", "Болт"), (None, None, "20 шт болт")]


def test_units(value):
    assert value(T.normalize_uom, "Штук.", " КГ ", "кв.м", "ящик", None) == ["шт", "кг", "м²", None, None]
    assert value(T.header_uom, "Кол-во, шт", "Количество (кг)", "Количество") == ["шт", "кг", None]


def test_preprocess_prefers_the_column(spark, value):
    df = spark.createDataFrame([("Болт 5 шт", "7", "кг"), ("Болт 5 шт", "", ""), ("Болт", "3 шт", ""), ("Болт", "9", ""), ("Болт по запросу", "", "")], "n string, q string, u string")
    got = [r["p"] for r in df.select(T.preprocess_row("n", "q", "u", F.lit("м"), ["по запросу"]).alias("p")).collect()]
    assert [(r["cleaned_name"], r["qty"], r["uom"]) for r in got] == [("Болт 5 шт", 7.0, "кг"), ("Болт", 5.0, "шт"), ("Болт", 3.0, "шт"), ("Болт", 9.0, "м"), ("Болт", None, None)]
    assert [r["source"] for r in got] == ["из отдельных колонок", "из наименования", "из колонки количества", "из заголовка", "не найдено"]
    assert got[4]["tail_phrase_cut"] == "по запросу"


def test_dash_and_thousands(value):
    assert [tuple(r) for r in value(T.dash_quantity, "Болт М12 - 10 000 шт", "a — 5 кг", "Болт М12-20", "x - y - 3 шт")] == [("Болт М12", 10000.0, "шт"), ("a", 5.0, "кг"), ("Болт М12-20", None, None), ("x - y", 3.0, "шт")]


def test_sizes(value):
    assert value(T.normalize_size, "М12 × 80 мм", "M-24", "m 24", "125x1,6x22мм", "_x0002_M8", None) == ["M12X80", "M24", "M24", "125X1.6X22", "M8", ""]
    assert value(T.size_key, "125x1,6x22мм", "M12x60", "нет") == ["1.6x22x125", "12x60", ""]


def test_sizes_close(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = spark.range(1).select(T.sizes_close(a(125, 22.2, 1.6), a(125, 1.6, 22)), T.sizes_close(a(10), a(11)), T.sizes_close(a(), a()), T.sizes_close(a(1, 2), a(1))).first()
    assert list(r) == [True, False, False, False]


def test_similarity_text_and_grams(value):
    assert value(T.similarity_text, "Болт М12×4,8 мм", "ЁЖ-х_1", None) == ["болт м12x4.8", "еж x 1", ""]
    assert value(T.char_ngrams, "ab cd", "abc", "") == [["ab_c", "b_cd"], ["abc"], []]
    assert value(T.keywords, "Болт для the foo Foo _x0009_бар") == [["foo", "бар", "болт"]]
    assert value(T.name_key, "Болт 12 мм, 5 шт.", "Шайба-12") == ["болт 12 5", "шайба 12"]


def test_standards(value):
    assert value(T.standard_keys, "DIN438/ ГОСТ1479 M10x20", "ГОСТ Р ИСО 4014", "ISO 4017 DIN 933 ISO 4017", "нет") == [["DIN-438", "GOST-1479"], ["GOST-4014"], ["ISO-4017", "DIN-933"], []]
    assert value(T.canonical_standard, "ГОСТ Р 52627", "DIN  933-A", "ГОСТ Р ИСО 4014", "ТУ 1", "") == ["GOST-52627", "DIN-933-A", "GOST-ИСО-4014", None, None]
    assert value(T.display_standard, "GOST-7798-70", "DIN-931-A", "ISO-4017") == ["ГОСТ 7798-70", "DIN 931-A", "ISO 4017"]
    assert [r and tuple(r) for r in value(T.standard_kind_code, "ГОСТ Р ИСО 4014", "ГОСТ 7798-70", "din 931", "x")] == [("ISO", "4014"), ("GOST", "7798-70"), ("DIN", "931"), None]


def test_rest(value):
    assert value(T.volume_ml, "0,5 л", "310 мл", "лента 5") == [500.0, 310.0, None]
    assert value(T.is_kit, "болт+гайка", "Набор", "болт") == [True, True, False]
    assert value(T.format_qty, "2.50", "10", "0.1234") == ["2.5", "10", "0.123"]
    assert value(T.is_note, "Примечание: срочно", "Болт", "все оцинкованное") == [True, False, True]
    assert value(lambda x: T.rewrite_standard(x, F.lit("DIN-933"), F.lit("GOST-7798-70")), "Болт DIN 933 М8") == ["Болт ГОСТ 7798-70 М8"]
    assert value(lambda x: T.render_name("{item_type} {size} {standard}", {"item_type": x, "size": F.lit("M8"), "gost": F.lit(""), "din": F.lit("DIN 933")}), "болт") == ["болт M8 DIN 933"]
