"""Extraction by rules, and the engines that judge rows."""

import pytest

from tallyforge.functions import extract as X
from tallyforge.functions import seeds
from tallyforge.operators import rules as R
from tallyforge.operators import snapshot

D = seeds.default_dictionary()


@pytest.fixture
def fields(spark):
    def compute(*texts):
        return X.line_record(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string"), D).orderBy("i").collect()

    return compute


def test_fields_of_lines(fields):
    got = fields("Болт М12х80 8.8 оцинк ГОСТ 7798-70", "Гайка M16 DIN 934", "Саморез 4,8х35", "M20x45.58 болт", "Гайка M12.6.019 (S27)", "Болт 8*70 8,8 кл.пр. 7798-70", "")
    pick = lambda r: (r["item_type"], r["diameter"], r["length"], r["size"], r["strength"], r["coating"], r["gost"], r["din"])
    assert [pick(r) for r in got] == [
        ("болт", "M12", "80", "M12x80", "8.8", "цинк", "ГОСТ 7798-70", ""), ("гайка", "M16", "", "M16", "", "", "", "DIN 934"), ("саморез", "4.8", "35", "4.8x35", "", "", "", ""),
        ("болт", "M20", "45", "M20x45", "5.8", "", "", ""), ("гайка", "M12", "", "", "6", "цинк хром. 9мкм", "", ""), ("болт", "M8", "70", "M8x70", "8.8", "", "ГОСТ 7798-70", ""), ("", "", "", "", "", "", "", ""),
    ]
    assert got[4]["wrench_size"] == "27" and got[0]["std_norm"] == "GOST-7798-70"


def test_rule_order_kinds_and_bad_patterns(spark):
    rules = (
        X.Rule(1, "coating", "zn", "contains", "a", "low", 1), X.Rule(2, "coating", "ZN", "exact", "b", "word", 5), X.Rule(3, "coating", "z(", "regex", "c", "broken", 9),
        X.Rule(4, "coating", r"z\d", "regex", "d", "digit", 7), X.Rule(5, "coating", "x", "contains", "e", "off", 99, active=False),
    )
    own = X.Dictionary(rules)
    df = spark.createDataFrame([("a zn b",), ("azn",), ("Z7 zn",), ("x",)], "t string")
    assert [r[0] for r in df.select(X.detect("t", own.of("coating"))).collect()] == ["word", "low", "digit", ""]


def test_own_columns_fill_what_the_text_lacks(spark):
    df = spark.createDataFrame([("Болт 8.8", "10", "7798-70", ""), ("Болт", "10", "DIN 933", ""), ("Болт", "", "", "ГОСТ 5915-70 12.9")], "raw_text string, strength_raw string, standard_raw string, note_raw string")
    got = X.transform(df, ["strength", "gost", "din", "nothing"], D).collect()
    assert [(r["strength"], r["gost"], r["din"]) for r in got] == [("8.8", "ГОСТ 7798-70", ""), ("10.9", "", "DIN 933"), ("12.9", "ГОСТ 5915-70", "")]
    assert "nothing" not in got[0].asDict()


def test_line_classes(spark):
    lines = ["Итого 100 руб", "Болт М12", "ИНН 123 КПП 4", "x", "наименование кол-во цена сумма", "", "Всего болт М8 5", "какой то большой текст"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(X.classify_line("t")).collect()] == ["total", "item", "requisites", "garbage", "header", "garbage", "item", "item"]


def rows(spark, *data):
    base = dict(name="n", qty="1", uom="шт", item_type="", size="", diameter="", length="", strength="", coating="", gost="", iso="", din="")
    return spark.createDataFrame([{"i": i, **base, **r} for i, r in enumerate(data)], "i int, " + ", ".join(f"{k} string" for k in base))


READY = [R.Readiness("default", None, ("name", "qty", "uom")), R.Readiness("bolt", "болт", ("size", "strength"), 10), R.Readiness("sub", "болт анкерный", ("coating",), 20)]


def test_readiness_levels(spark):
    df = rows(spark, {"item_type": "болт", "size": "M8", "strength": "8.8"}, {"item_type": "болт", "size": "M8"}, {"item_type": "болт"}, {"item_type": "диск", "uom": ""}, {"name": " - ", "item_type": "болт"})
    got = R.evaluate(df, READY).orderBy("i").collect()
    assert [r["status"] for r in got] == ["ok", "review", "manual", "manual", "manual"]
    assert got[4]["reason"] == "Пустое наименование" and got[1]["reason"] == "Не хватает: Класс прочности"
    assert [r["status"] for r in R.evaluate(df, [R.Readiness("bolt", "болт", ("size",))]).orderBy("i").collect()][3] == "manual"
    assert [r["status"] for r in R.evaluate(df, []).orderBy("i").collect()][:4] == ["ok"] * 4


def test_subtype_by_keyword_and_size_by_diameter(spark):
    own = [R.Inference("KEYWORD_TO_ITEM_TYPE", ("болт",), "анкер", "болт анкерный"), R.Inference("DIAMETER_X_LENGTH_AS_SIZE", ("болт",), priority=2), R.Inference("DIAMETER_AS_SIZE", ("гайка",), priority=1)]
    df = rows(spark, {"item_type": "болт", "name": "Анкерный болт", "diameter": "M8", "length": "20"}, {"item_type": "гайка", "diameter": "M8"}, {"item_type": "болт", "diameter": "M8"}, {"item_type": "гайка", "size": "M9", "diameter": "M8"})
    got = R.evaluate(df, READY, inference_rules=own).orderBy("i").collect()
    assert [(r["item_subtype"], r["size"]) for r in got] == [("болт анкерный", "M8x20"), (None, "M8"), (None, ""), (None, "M9")]
    assert got[0]["readiness_rule"] == "sub"


def test_standards_fill_and_contradict(spark):
    directory = spark.createDataFrame([*seeds.STANDARDS, ("DIN", "933", "болт")], "kind string, code string, item_type string")
    df = rows(spark, {"din": "DIN 934"}, {"item_type": "болт", "size": "M8", "strength": "8.8", "din": "DIN 934"}, {"item_type": "болт", "size": "M8", "strength": "8.8", "gost": "ГОСТ Р ИСО 4014"})
    got = R.evaluate(df, READY, directory).orderBy("i").collect()
    assert [(r["item_type"], r["item_type_source"], r["status"]) for r in got] == [("гайка", "из стандарта", "ok"), ("болт", "из текста", "review"), ("болт", "из текста", "ok")]
    assert len(got) == 3


def test_validation_only_worsens(spark):
    directory = spark.createDataFrame(seeds.STANDARDS, "kind string, code string, item_type string")
    own = [R.Validation("болт", forbidden=("coating",), force_status="review"), R.Validation(None, required=("length",)), R.Validation(condition="STANDARD_MATCH", force_status="manual"), R.Validation(condition="STANDARD_MATCH", mode="FIXED", expected="винт", source="DIN", force_status="ok")]
    df = rows(spark, {"item_type": "болт", "coating": "цинк", "length": "5"}, {"item_type": "болт", "din": "DIN 934", "length": "1"}, {"item_type": "болт", "length": "1"})
    got = R.evaluate(df, [], directory, (), own).orderBy("i").collect()
    assert [r["status"] for r in got] == ["review", "manual", "ok"]
    assert "запрещено: Покрытие" in got[0]["reason"] and "ожидается «винт»" in got[1]["reason"]


def test_categories(spark):
    _, _, categories, exceptions = R.defaults()
    df = rows(spark, {"item_type": "болт", "name": "Болт", "diameter": "M8", "length": "5", "strength": "8.8", "coating": "цинк", "din": "DIN 933"}, {"name": "Анкер забиваемый стальной", "diameter": "M8"}, {"name": "анкер", "diameter": "M8"}, {"name": "саморез", "din": "DIN 7981", "length": "3"}, {"name": "штифт", "din": "DIN 94", "diameter": "2", "length": "3"}, {"name": "диск"}, {"name": "Болт мебельный a2"})
    got = R.merge_category(R.category_status(R.categorize(R.evaluate(df, [])), categories, exceptions)).orderBy("i").collect()
    assert [(r["category"], r["category_status"]) for r in got] == [("metric_fasteners", "ok"), ("anchors", "ok"), ("anchors", "needs_review"), ("din_screws", "manual_required"), ("pins_cotter", "needs_review"), (None, None), ("stainless_fasteners", "manual_required")]
    assert [r["status"] for r in got] == ["ok", "ok", "review", "manual", "review", "ok", "manual"]


def test_snapshots_and_differences(spark):
    text = snapshot.take({"readiness": READY})
    assert snapshot.load(text, {"readiness": R.Readiness})["readiness"] == READY
    assert snapshot.load("broken", {"readiness": R.Readiness}) == {"readiness": []}
    rules = [X.Rule(1, "coating", "a", "contains", "a", "A")]
    more = snapshot.put(rules, X.Rule(snapshot.next_id(rules), "coating", "b", "contains", "b", "B"))
    assert [r.id for r in more] == [1, 2] and snapshot.drop(more, 1)[0].id == 2 and not snapshot.toggle(more, 1)[0].active and snapshot.counts({"x": more}) == {"x": 2}
    df = rows(spark, {"item_type": "болт", "size": "M8"}, {"item_type": "диск"})
    got = snapshot.diff(R.evaluate(df, READY), R.evaluate(df, []), "i", ["status", "size"]).collect()
    assert [tuple(r) for r in got] == [(0, "status", "review", "ok")]


def test_traces_have_every_stage(spark):
    df = spark.createDataFrame([(0, "Болт М8х20 8.8 цинк DIN 933", "Болт М8х20"), (1, "что-то", "")], "row_id long, raw_text string, name string")
    readiness, inference, categories, exceptions = R.defaults()
    decisions = spark.createDataFrame([(0, "AUTO_EXACT", 7, 100)], "row_id long, mode string, item_id long, score int")
    t = {r["row_id"]: r["trace"] for r in R.traces(df, seeds.default_dictionary(), readiness, spark.createDataFrame(seeds.STANDARDS, "kind string, code string, item_type string"), inference, (), categories, exceptions, decisions).collect()}
    assert list(t[0].asDict()) == ["raw", "extracted", "detection", "enrichment", "inference", "readiness", "validation", "final", "matching", "category"]
    assert (t[0]["raw"]["name"], t[0]["extracted"]["size"], t[0]["detection"]["strength"], t[0]["enrichment"]["standard_type"], t[0]["matching"]["item_id"], t[0]["category"]["category"]) == ("Болт М8х20", "M8x20", "8.8", "болт", 7, "metric_fasteners")
    assert t[0]["detection"]["strength_rule"].isdigit() and t[1]["final"]["status"] == "manual" and t[1]["matching"]["mode"] is None


def test_rule_tables_are_loaded_by_priority(spark):
    table = spark.createDataFrame([(1, "b", None, '["size", "qty"]', 5, True), (2, "a", "болт", "[]", 0, True), (3, "c", None, "[]", 0, False)], "id long, name string, item_type string, required string, priority int, active boolean")
    assert R.load(table, R.Readiness) == [R.Readiness("a", "болт", (), 0), R.Readiness("b", None, ("size", "qty"), 5)]
    with pytest.raises(ValueError):
        R.load(spark.range(R.MOST_RULES + 1).selectExpr("id", "'x' as name", "null as item_type", "'[]' as required"), R.Readiness)


def test_names_parsed_once(spark):
    df = spark.createDataFrame([(0, "Болт М8"), (1, " болт м8 "), (2, ""), (3, "Гайка")], "pos int, name string")
    assert sorted(r["pos"] for r in X.parse_names(df, D).collect()) == [0, 3]


def test_rules_from_a_table(spark):
    t = spark.createDataFrame([(1, "coating", "zn", "contains", "z", "цинк", 5, True)], "id int, kind string, pattern string, match string, code string, name string, priority int, active boolean")
    own = X.Dictionary(X.rules_of(t))
    assert spark.createDataFrame([("zn",)], "t string").select(X.coating("t", own)).first()[0] == "цинк"


def test_too_many_rules_are_an_error(spark):
    import pytest

    from tallyforge.functions import extract

    rules = spark.range(extract.MOST_RULES + 1).selectExpr("id", "'size' AS kind", "'x' AS pattern", "'contains' AS match", "'x' AS code", "'x' AS name")
    with pytest.raises(ValueError, match="more than"):
        extract.rules_of(rules)
