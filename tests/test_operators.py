"""Matching, grouping, quotes, catalogue and metrics on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import seeds
from tallyforge.functions import text as T
from tallyforge.operators import catalog, cluster, matching, metrics, quotes
from tallyforge.operators import similarity as S
from tallyforge.operators.graph import saved

D = seeds.default_dictionary()


def catalogue(spark, rows):
    df = spark.createDataFrame([(i, n, u, p, f, a) for i, n, u, p, f, a in rows], "item_id long, name string, uid_1c string, folder_priority int, folder_path string, is_active boolean")
    r = X.line_record(df, D, "name").withColumn("standard_key", F.coalesce(T.standard_key("name"), F.lit("")))
    return saved(r.withColumns({"std_key": F.col("standard_key"), "canonical_key": T.canonical_key("item_type", F.col("standard_key"), "size"), "tokens": S.item_tokens("name", "type_norm", F.col("standard_key"), F.col("size"))}))


def requests(spark, *texts):
    r = X.line_record(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, raw_text string"), D).withColumn("name", F.col("raw_text"))
    r = r.withColumns({"std_key": F.coalesce(T.standard_key("raw_text"), F.lit("")), "fingerprint": T.fingerprint({f: F.col(f) for f in X.FIELDS if f in ("item_type", "size", "diameter", "length", "gost", "iso", "din", "strength", "coating")})})
    return saved(r.withColumn("tokens", S.item_tokens("raw_text", "type_norm", F.col("std_key"), F.col("size"))))


ITEMS = [(1, "Болт М8х20 DIN 933", "G1", 1, "Основной", True), (2, "Болт М8х20 DIN 933 цинк", "G2", 2, "_архив", True), (3, "Болт М8х20 ГОСТ 7798-70", "G3", None, "x", True), (4, "Болт М8х20", "G4", None, "x", True), (5, "Гайка М10 DIN 934", "G5", 1, "x", True), (6, "Болт М8х20 DIN 931", "G6", 1, "x", False)]


@pytest.fixture
def equivalents(spark):
    return spark.createDataFrame([(a, b, True) for a, b, _ in seeds.EQUIVALENTS], "src_canonical string, dst_canonical string, is_active boolean")


def test_exact_candidates_by_analogue_mode(spark, equivalents):
    items, r = catalogue(spark, ITEMS), requests(spark, "Болт М8х20 DIN 933", "Болт М8х20", "Шайба М8")
    off = matching.exact_candidates(r, items).collect()
    assert sorted((x["row_id"], x["item_id"], x["score"]) for x in off) == [(0, 2, 100), (0, 4, 97), (1, 2, 100), (1, 3, 100), (1, 4, 100)]
    wide = matching.exact_candidates(r, items, matching.Settings(analogs="with"), equivalents).where("row_id = 0").orderBy("rank").collect()
    assert [(x["item_id"], x["score"], x["standard_mode"]) for x in wide] == [(2, 100, "exact"), (4, 97, "none"), (3, 95, "analog")]
    only = matching.exact_candidates(r, items, matching.Settings(analogs="only"), equivalents).where("row_id = 0").collect()
    assert [x["item_id"] for x in only] == [3]


def test_score_deductions(spark):
    s = lambda *a: matching.exact_score(*[F.lit(x) for x in a])
    r = spark.range(1).select(s("A", "A", False, "8.8", "8.8", "z", "z"), s("A", "B", True, "", "", "", ""), s("A", "B", False, "8.8", "10.9", "z", "n"), s("A", "", False, "", "", "", ""), s("", "B", False, "", "", "", "")).first()
    assert list(r) == [100, 95, 65, 97, 100]


def test_decision_stages(spark, equivalents):
    items = catalogue(spark, ITEMS)
    r = requests(spark, "Болт М8х20 DIN 933", "Гайка М10 DIN 934 оцинкованная", "Гайка DIN 934 М10 черная б/п", "совсем другое", "Болт М8х20 DIN 931")
    memory = r.where("row_id = 1").select("fingerprint", F.lit(5).cast("long").alias("item_id"), F.lit(1).alias("confirmed_at"))
    got = {x["row_id"]: x for x in matching.decide(r, items, memory=memory, equivalents=equivalents).collect()}
    assert {k: v["mode"] for k, v in got.items()} == {0: "AUTO_EXACT", 1: "AUTO_MEMORY", 2: "AUTO_EXACT", 3: "NONE", 4: "AUTO_EXACT"} and len(got) == 5
    ask = {x["row_id"]: x["mode"] for x in matching.decide(r, items, matching.Settings(always_confirm=True), memory).collect()}
    assert set(ask.values()) == {"SUGGESTED", "NONE"}


def test_similar_rows_are_found_and_filtered(spark):
    items = catalogue(spark, ITEMS)
    r = requests(spark, "Болт М8х20 DIN 933 п").withColumns({"type_norm": F.lit(""), "size_norm": F.lit("M8X20")})
    got = matching.decide(r, items).first()
    assert (got["source"], got["item_id"], got["mode"]) == ("minhash", 1, "AUTO_MINHASH")
    other = matching.decide(r.withColumn("size_norm", F.lit("M99X9")), items).first()
    assert other["mode"] != "AUTO_MINHASH" and other["candidates"] == []


def test_lists_take_one_item_of_each_key(spark):
    items = spark.createDataFrame([(i, f"k{i % 3}" if i < 9 else "", "DIN-1" if i == 4 else "") for i in range(12)], "item_id long, canonical_key string, std_key string")
    rows = spark.createDataFrame([(0, "DIN-1"), (1, "")], "row_id long, std_key string")
    pairs = spark.createDataFrame([(0, i, 0.9 - i / 100, "DIN-2" if i == 10 else None) for i in range(12)], "row_id long, item_id long, jaccard double, via string")
    got = matching.candidate_list(pairs, rows, items, matching.Settings(candidates=4)).orderBy("rank").collect()
    assert [(r["item_id"], r["score"], r["standard_mode"]) for r in got] == [(0, 90, "none"), (1, 89, "none"), (2, 88, "none"), (9, 81, "none")]
    wide = matching.candidate_list(pairs.where("item_id > 3"), rows, items).collect()
    assert {r["item_id"]: r["standard_mode"] for r in wide} == {4: "exact", 5: "none", 6: "none", 9: "none", 10: "analog", 11: "none"}


def test_analogues_are_searched_and_named(spark, equivalents):
    items = catalogue(spark, ITEMS)
    r = requests(spark, "Болт М8х20 ГОСТ 7798-70 DIN 933 и ещё").withColumn("type_norm", F.lit(""))
    asked = {x["via"]: x["text"] for x in matching.analog_queries(r, equivalents).collect()}
    assert asked == {"DIN-933": "Болт М8х20 DIN 933 DIN 933 и ещё", "GOST-7798-70": "Болт М8х20 ГОСТ 7798-70 ГОСТ 7798-70 и ещё", "ISO-4017": "Болт М8х20 ГОСТ 7798-70 ISO 4017 и ещё"}
    got = matching.decide(r, items, matching.Settings(analogs="with"), equivalents=equivalents).first()
    assert got["source"] == "minhash" and (got["via_analog"] is not None) == got["mode"].endswith("ANALOG")
    only = matching.rematch(r, items, True, matching.Settings(analogs="only"), equivalents).collect()
    assert all(x["stage"] == "minhash" for x in only)


def test_status_of_rows_and_first_candidates(spark):
    s = lambda mode, status, missing: matching.row_status(F.lit(mode), F.lit(status).cast("string"), F.array(*[F.lit(m) for m in missing]).cast("array<string>"))
    got = spark.range(1).select(s("AUTO_EXACT", "ok", []), s("NONE", None, []), s("AUTO_MINHASH", "manual_required", ["size"])).first()
    assert [tuple(x) for x in got] == [("ok", ""), ("review", ""), ("manual", "Проверка заявки: size")]


def test_ladder_drops_the_standard_first(spark):
    cols = "row_id long, item_id long, jaccard double, row_size string, item_size string, row_std string, item_std string, row_type string, item_type string"
    p = [
        (1, 1, 0.9, "M8", "M8", "DIN-1", "DIN-2", "болт", "болт"), (1, 2, 0.8, "M8", "M9", "DIN-1", "DIN-1", "болт", "болт"), (2, 1, 0.9, "M8", "M8", "", "DIN-2", "болт", "болт"), (2, 2, 0.8, "M8", "M8", "", "", "болт", "гайка"),
        (3, 1, 0.9, "M8", "M9", "", "", "", ""), (4, 1, 0.9, "", "M9", "DIN-1", "DIN-2", "болт", "гайка"), (5, 1, 0.9, "M8", "M8", "", "", "болт", "гайка"), (6, 1, 0.9, "125X22.2X1.6", "125X1.6X22", "", "", "", ""),
    ]
    got = matching.filter_ladder(matching.badges(spark.createDataFrame(p, cols))).collect()
    assert sorted((r["row_id"], r["item_id"], r["filter_level"]) for r in got) == [(1, 1, 1), (2, 1, 0), (4, 1, 2), (5, 1, 2), (6, 1, 0)]


def test_weighted_scores(spark):
    cols = "r_type string, r_size string, r_key string, r_strength string, r_coating string, r_text string, i_type string, i_size string, i_key string, i_strength string, i_coating string, i_text string, folder_priority int"
    df = spark.createDataFrame([
        ("болт", "M8x20", "DIN-933", "8.8", "", "болт", "болт", "M8x20", "DIN-933", "8.8", "", "болт", None), ("болт", "M8x20", "", "", "", "болт", "гайка", "M10", "", "", "", "гайка", None),
        ("болт", "M8x20", "", "", "", "болт", "болт", "M8x30", "", "", "", "болт", 1), ("", "", "", "", "", "", "", "", "", "", "", "", None), ("болт", "", "", "", "", "болт", "болт", "", "", "", "", "комплект болт", None),
    ], cols)
    got = [r["score"] for r in matching.weighted_score(df).collect()]
    assert got[0] >= 90 and got[1] <= 20 and 60 <= got[2] <= 95 and got[3] == 0 and got[4] <= 45


def test_signatures_estimate_jaccard(spark):
    df = spark.createDataFrame([([f"t{i}" for i in range(100)], [f"t{i}" for i in range(50, 150)])], "a array<string>, b array<string>")
    r = df.select(S.estimate(S.signature(F.col("a")), S.signature(F.col("b"))).alias("e"), S.jaccard(F.col("a"), F.col("b")).alias("j"), S.signature(F.array().cast("array<string>")).alias("n")).first()
    assert abs(r["e"] - r["j"]) < 0.15 and r["n"] is None


def test_signatures_of_tables_are_those_of_the_expression(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, [f"t{i}" for i in range(500)]), (5, ["a", "b"])], "item_id long, tokens array<string>")
    got = {r["item_id"]: r["signature"] for r in S.signatures(df, ["item_id"]).collect()}
    assert got == {r["item_id"]: r["s"] for r in df.select("item_id", S.signature(F.col("tokens")).alias("s")).collect()}
    bands = {r["item_id"]: r["bands"] for r in S.banded(df, "item_id").collect()}
    assert bands[1] == bands[5] and bands[2] is None and len(bands[4]) == S.BANDS and not set(bands[1]) & set(bands[4])


def test_rows_with_few_pairs(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "row_id long, item_id long")
    assert sorted(r["row_id"] for r in S.lacking(spark.range(1, 4).withColumnRenamed("id", "row_id"), pairs, "row_id", 2).collect()) == [1, 3]


def test_groups_parents_and_reasons(spark, equivalents):
    items = catalogue(spark, [
        (1, "Болт М8х20", "B", None, "x", True), (2, "болт М8Х20", "A", None, "x", True), (3, "Болт М8х20 DIN 933", "C", 2, "x", True), (4, "Болт М8х20 ГОСТ 7798-70", "D", 1, "_x", True), (5, "Болт М9х20", "E", 1, "x", True), (6, "Болт М8х20", "F", 1, "x", False),
        (7, "Болт", "H", 1, "x", True),
    ])
    links = cluster.duplicate_links(items).unionByName(cluster.analog_pairs(items, equivalents))
    g = cluster.groups(items, links)
    assert sorted((r["item_id"], r["group_id"]) for r in g.collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    m = cluster.child_reasons(cluster.elect_parent(g, items), links)
    assert {r["item_id"]: (r["role"], r["reason"]) for r in m.collect()} == {1: ("child", "duplicate"), 2: ("parent", "duplicate"), 3: ("child", "analog"), 4: ("parent", "analog")}
    rep = cluster.group_report(cluster.elect_parent(g, items), "гост").collect()
    assert {(r["item_id"], r["group_num"]) for r in rep} == {(3, 1), (4, 1)}


def test_links_make_the_groups_of_all_pairs(spark):
    rows = [(i, "Болт", "болт", "M8", "", "", k, True) for i, k in enumerate(["", "A", "B", "A", "", "C"])] + [(10 + i, "Гайка", "гайка", "M8", "", "", k, True) for i, k in enumerate(["A", "B", "A", "C"])]
    items = spark.createDataFrame(rows, "item_id long, name string, item_type string, size string, diameter string, length string, standard_key string, is_active boolean")
    a = cluster.groups(items, cluster.duplicate_links(items)).collect()
    b = cluster.groups(items, cluster.duplicate_pairs(items)).collect()
    assert sorted(a) == sorted(b) and {r["item_id"] for r in a} == {0, 1, 2, 3, 4, 5, 10, 12}


def quote_tables(spark):
    lines = spark.createDataFrame([
        (1, 1, 1, "болт", "M8", "DIN-933", "item", ["a", "b"], 5.0), (1, 1, 2, "болт", "M8", "DIN-933", "item", ["a"], 6.0), (1, 1, 3, "", "", "", "total", ["x"], None), (1, 2, 4, "болт", "M8", "GOST-7798-70", "item", ["a"], 4.0),
        (1, 2, 5, "болт", "M8", "DIN-1", "item", ["a"], 1.0), (1, 2, 6, "винт", "", "", "item", ["p", "q", "r"], 2.0), (1, 2, 7, "винт", "M99", "", "item", ["p", "q", "r"], 2.0), (1, 2, 8, "", "", "", "item", [], 2.0),
    ], "order_id long, quote_id long, line_id long, type_norm string, size_norm string, std_norm string, line_class string, tokens array<string>, price double").withColumns({"qty": F.lit(1.0), "unit": F.lit("шт")})
    items = spark.createDataFrame([(1, 10, "болт", "M8", "DIN-933", ["a", "b"]), (1, 11, "винт", "M5", "", ["p", "q", "r"]), (1, 12, "винт", "M6", "", ["p", "z"])], "order_id long, item_id long, type_norm string, size_norm string, std_norm string, tokens array<string>")
    return lines, items


def test_quotes_are_matched_one_to_one(spark, equivalents):
    lines, items = quote_tables(spark)
    m = quotes.match_quotes(lines, items, equivalents)
    assert {r["line_id"]: (r["match_mode"], r["item_id"]) for r in m.collect()} == {1: ("auto", 10), 2: ("suggested", None), 3: (None, None), 4: ("auto", 10), 5: ("suggested", None), 6: ("auto", 11), 7: (None, None), 8: (None, None)}
    q = spark.createDataFrame([(1, 1), (2, 2)], "quote_id long, supplier_id long")
    s = spark.createDataFrame([(1, "A"), (2, "B")], "supplier_id long, name string")
    cells = quotes.comparison(m, lines, items, q, s)
    assert {(r["item_id"], r["supplier"], r["price"], r["cheapest"]) for r in cells.collect()} == {(10, "A", 5.0, False), (10, "B", 4.0, True), (11, "B", 2.0, True), (12, None, None, False)}
    assert {r["item_id"]: (r["A"], r["B"]) for r in quotes.pivoted(cells, ["A", "B"]).collect()} == {10: (5.0, 4.0), 11: (None, 2.0), 12: (None, None)}
    assert quotes.match_counts(m).first().asDict() == {"order_id": 1, "total_lines": 8, "matched_auto": 3, "suggested": 2, "unmatched": 2, "filtered_out": 1}
    assert {(r["supplier"], r["kind"], r["lines"]) for r in quotes.unmatched(m, q, s).collect()} == {("A", "unmatched", 1), ("A", "filtered", 1), ("B", "unmatched", 3)}


def test_wizard_rows(spark):
    g = spark.createDataFrame([(1, ["Болт", "5 шт", "1 200,50", "x"])], "row_index int, cells array<string>")
    r = quotes.wizard_rows(g, {"name": 0, "qty": 1, "price": 2, "unit": 9}).first()
    assert (r["raw_text"], r["qty"], r["price"], r["unit"], r["price_total"]) == ("Болт", 5.0, 1200.5, "", None)


def test_catalogue_sync(spark):
    old = spark.createDataFrame([("a", None, "A", True), ("b", "1", "B", True), ("c", None, "C", False), ("d", None, "D", False), ("e", None, "E", True)], "uid string, char string, name string, is_active boolean")
    new = spark.createDataFrame([("a", None, "A2"), ("d", "", "D"), ("n", None, "N"), ("e", None, "E")], "uid string, char string, name string")
    got = {r["uid"]: (r["action"], r["name"], r["is_active"]) for r in catalog.sync(old, new).collect()}
    assert got == {"a": ("updated", "A2", True), "b": ("deactivated", "B", False), "c": ("inactive", "C", False), "d": ("updated", "D", True), "n": ("created", "N", True), "e": ("unchanged", "E", True)}


def test_folders_with_a_cycle(spark):
    f = spark.createDataFrame([("r", "Root", None, 3), ("a", "A", "r", None), ("b", "B", "a", None), ("x", "X", "y", None), ("y", "Y", "x", 7), ("o", "O", "gone", None)], "folder_uid string, folder_name string, parent_uid string, priority int")
    got = {r["folder_uid"]: (r["path"], r["priority"]) for r in catalog.folder_paths(f).collect()}
    assert got["b"] == ("Root / A / B", 3) and got["r"] == ("Root", 3) and got["x"] == ("Y / X", 7) and got["o"] == ("O", None)


def test_masters_search_versions(spark):
    masters = spark.createDataFrame([(1, "M", True), (2, "N", False)], "master_item_id long, name string, is_active boolean")
    members = spark.createDataFrame([(1, "g1", False), (1, "g2", True), (2, "g1", True)], "master_item_id long, onec_guid string, is_primary boolean")
    assert catalog.master_groups(masters, members).first()["members"] == ["g2", "g1"]
    assert [r["onec_guid"] for r in catalog.member_conflicts(members).collect()] == ["g1"]
    assert {r["onec_guid"]: r["is_primary"] for r in catalog.with_primary(members, 1, "g1").where("master_item_id = 1").collect()} == {"g1": True, "g2": False}
    items = catalogue(spark, ITEMS)
    assert [r["item_id"] for r in catalog.search(items, "ГАЙКА", ["name"], ["item_id"]).collect()] == [5]
    assert catalog.snapshot_version(items) == catalog.snapshot_version(items.orderBy(F.desc("item_id"))) != catalog.snapshot_version(items.where("item_id > 1"))
    assert catalog.recomputed_keys(items.withColumn("canonical_key", F.lit("old"))).where("changed").count() == 6
    put, gone = catalog.delta(items.select("item_id", "name").where("item_id < 5"), items.select("item_id", F.when(F.col("item_id") == 2, "new").otherwise(F.col("name")).alias("name")).where("item_id > 1"), "item_id")
    assert sorted(r["item_id"] for r in put.collect()) == [2, 5, 6] and sorted(r["item_id"] for r in gone.collect()) == [1, 2]
    memory = spark.createDataFrame([("f", 1, 1)], "fingerprint string, item_id long, confirmed_at long")
    assert [tuple(r) for r in matching.remember(memory, spark.createDataFrame([("f", 2, 2)], memory.schema)).collect()] == [("f", 2, 2)]


def test_metrics(spark):
    df = spark.createDataFrame([("ok",), ("ok",), ("review",), ("manual",)], "status string")
    assert metrics.status_counts(df).first().asDict() == {"ok": 2, "review": 1, "manual": 1, "total": 4, "ok_pct": 50}
    assert metrics.status_counts(df.where("false")).first()["ok_pct"] == 0
    when = datetime.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(i, when + datetime.timedelta(days=i), 10, i, 5, 1, 3, 1) for i in range(4)], "id long, created_at timestamp, total_client_lines long, parsed_client_lines long, auto_matches long, manual_matches long, system_match_correct long, system_match_incorrect long")
    q = metrics.quality(runs, 2).first()
    assert (q["total_runs"], q["parse_success_rate"], q["auto_match_rate"], q["match_accuracy"]) == (2, 0.25, 0.5, 0.75)
    assert [r["id"] for r in metrics.history(runs, 2).collect()] == [2, 3]
    steps = spark.createDataFrame([("parse", '{"a": 0.5}'), ("parse", "{}"), ("other", '{"a": 9}'), ("parse", None)], "step_name string, extra_json string")
    assert metrics.step_means(steps, ["a"], "parse").first().asDict() == {"n": 2, "a": 0.25}
    feedback = spark.createDataFrame([(1, True), (2, False), (99, False)], "pipeline_run_id long, is_correct boolean")
    assert metrics.correction_rate(runs, feedback).first().asDict() == {"total_feedbacks": 2, "overrides": 1, "correction_rate": 0.05}
    rows = spark.createDataFrame([("c", "болт", "Болт ", "8.8", None), ("c", "болт", "гайка", None, ""), ("s", None, None, "1", "1")], "source_type string, got_t string, expected_t string, got_s string, expected_s string").withColumn("k", F.monotonically_increasing_id())
    assert {r["source_type"]: (r["checks"], r["correct"], r["accuracy"]) for r in metrics.evaluation(rows, ["t", "s"]).collect()} == {"c": (2, 1, 0.5), "s": (1, 1, 1.0)}
    assert {r["field"]: (r["checks"], r["correct"], r["errors"]) for r in metrics.field_stats(rows, ["t", "s"]).collect()} == {"t": (2, 1, 1), "s": (1, 1, 0)}
    assert [(r["field"], r["got"], r["expected"]) for r in metrics.errors(rows, ["t", "s"], "k").collect()] == [("t", "болт", "гайка")]
    out, step = metrics.timed("filter", lambda d: d.where("status = 'ok'"), df)
    assert out.count() == 2 and step["success_rate"] == 0.5


def test_tokens_of_quotes_are_made_of_lines_without_an_exact_pair(spark):
    """Lines that exact fields decide, and items of orders without other lines, have no tokens made; the result is the same."""
    fields = "type_norm string, size_norm string, std_norm string, name string"
    lines = spark.createDataFrame([(1, "q1", 1, "item", "bolt", "M8", "", "bolt m8"), (1, "q1", 2, "item", "", "", "", "ring m9 zinc"), (2, "q2", 3, "item", "bolt", "M8", "", "bolt m8")], "order_id long, quote_id string, line_id long, line_class string, " + fields)
    items = spark.createDataFrame([(1, 10, "bolt", "M8", "", "bolt m8"), (1, 11, "ring", "M9", "", "ring m9 zinc"), (2, 12, "bolt", "M8", "", "bolt m8")], "order_id long, item_id long, " + fields)
    made = lambda df: df.withColumn("tokens", F.split("name", " "))
    seen = []
    got = quotes.match_quotes(lines, items, tokens=lambda df: seen.append(df.count()) or made(df))
    assert seen == [1, 2] and sorted(map(tuple, got.collect())) == sorted(map(tuple, quotes.match_quotes(made(lines), made(items)).collect()))
