"""Substring search through postings, and folder paths by pointer jumping, against plain versions."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import catalog, search_index
from tallyforge.operators.search_index import SearchIndex


def test_search_is_the_scan(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("абВг 𝄞1") for _ in range(rng.randint(0, 9)))
    rows = [(i, rng.choice([word(), None]), word(), f"x{i}", 1) for i in range(150)] + [(500 + i, "Аб вг", "same", "x", 1) for i in range(60)] + [(900, "д" * 20_000 + "Ж", None, None, 1)]
    items = spark.createDataFrame(rows, "item_id long, name string, brand string, query string, rank int")
    asks = [(i, word()) for i in range(40)] + [(100, ""), (101, None), (102, "АБ"), (103, "аб вг"), (104, "нет такого"), (105, "\u0000"), (106, "ддЖ"), (107, "same"), (107, "same")]
    asked = spark.createDataFrame(asks[:-1], "query_id long, query string")
    index = SearchIndex(spark, "search_test", ("name", "brand"), 4).build(items)
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in index.search(asked, items.select("item_id", "name", "brand"), [F.asc_nulls_first("name"), F.col("item_id")], 5).collect())
    index.drop()
    want = []
    for q, text in asks[:-1]:
        low = (text or "").lower()
        hits = sorted(((n is not None, n or "", i) for i, n, b, *_ in rows if low in (n or "").lower() or low in (b or "").lower()))
        want += [(q, k, i) for k, (_, _, i) in enumerate(hits[:5], 1)]
    assert got == sorted(want)


def plain_paths(rows):
    by = {u: (n or "", p or None, o) for u, n, p, o in rows}
    out = {}
    for u in by:
        names, prio, at, seen = [], None, u, []
        while at in by and at not in seen:
            seen.append(at)
            n, p, o = by[at]
            names.insert(0, n)
            prio = o if prio is None else prio
            at = p
        out[u] = " / ".join(x for x in names if x), prio, len(seen)
    return out


def test_paths_of_trees_gaps_and_cycles(spark):
    rng = random.Random(3)
    rows = [(f"f{i}", rng.choice([f"n{i}", "", None]), rng.choice([None, "", "gone", *([f"f{rng.randrange(i)}"] * 5 if i else [])]), rng.choice([None, None, i])) for i in range(300)]
    rows += [("a", "A", "b", None), ("b", "B", "c", 2), ("c", "C", "a", None), ("d", "D", "a", None), ("e", "E", "e", None), ("k", "K", "d", 1)]
    got = catalog.folder_paths(spark.createDataFrame(rows, "folder_uid string, folder_name string, parent_uid string, priority int")).collect()
    assert {r["folder_uid"]: (r["path"], r["priority"], r["level"]) for r in got} == plain_paths(rows) and len(got) == len(rows)
    assert catalog.folder_paths(spark.createDataFrame([], "folder_uid string, folder_name string, parent_uid string, priority int")).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    save = catalog.saved
    monkeypatch.setattr(catalog, "saved", lambda df: rounds.append(1) or save(df))
    n = 20_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("folder_uid"), F.when(F.col("id") % 5000 == 0, F.concat(F.lit("n"), "id")).alias("folder_name"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_uid"), F.when(F.col("id") == 7, 3).alias("priority"))
    last = catalog.folder_paths(chain).where(F.col("folder_uid") == str(n - 1)).first()
    assert (last["path"], last["priority"], last["level"]) == ("n0 / n5000 / n10000 / n15000", 3, n) and len(rounds) <= 17


def test_parts_of_runs_merge_to_the_whole(spark, tmp_path):
    from tallyforge.operators import metrics

    rng = random.Random(9)
    rows = [(f"d{i % 4}", rng.choice(["a", "b", None]), f"u{rng.randint(0, 300)}", rng.choice([None, float(i % 101)])) for i in range(4000)] + [("d9", "lone", None, None)]
    df = spark.createDataFrame(rows, "day string, kind string, who string, x double")
    path = str(tmp_path / "parts")
    for day in ("d0", "d1", "d2", "d3", "d9", "d2", "d2"):  # one run comes three times
        metrics.keep_parts(metrics.parts(df.where(F.col("day") == day), ["day", "kind"], "x", "who"), path, "day")
    got = {r["kind"]: r for r in metrics.shown(metrics.merged(spark.read.parquet(path), ["kind"])).collect()}
    assert set(got) == {"a", "b", None, "lone"}
    for kind, r in got.items():
        own = [x for x in rows if x[1] == kind]
        values = sorted(x[3] for x in own if x[3] is not None)
        assert r["n"] == len(own) and r["least"] == min(values, default=None) and r["most"] == max(values, default=None)
        if values:
            assert abs(r["total"] - sum(values)) < 1e-6 and abs(r["mean"] - sum(values) / len(values)) < 1e-9 and abs(r["median"] - values[len(values) // 2]) <= 3
            assert abs(r["entities"] - len({x[2] for x in own})) <= 10
    assert got["lone"]["mean"] is None and got["lone"]["entities"] == 0
    assert metrics.parts(df.where("false"), ["day", "kind"], "x", "who").count() == 0


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """Postings meet different queries only; every asker still gets the whole result."""
    seen = []
    make = search_index._postings
    monkeypatch.setattr(search_index, "_postings", lambda df, key, text, longest: (seen.append(df.count()) if longest else None) or make(df, key, text, longest))
    items = spark.createDataFrame([(i, f"bolt {i % 7}", "b") for i in range(40)], "item_id long, name string, brand string")
    asked = spark.createDataFrame([(i, ("BOLT", "bolt", "olt 3", "none")[i % 4]) for i in range(80)], "query_id long, query string")
    index = SearchIndex(spark, "search_once", ("name", "brand"), 4).build(items)
    got = index.search(asked, items, [F.col("name"), F.col("item_id")], 5).groupBy("query_id").count().collect()
    index.drop()
    assert seen == [3] and {r["query_id"]: r["count"] for r in got} == {i: 5 for i in range(80) if i % 4 < 3}


def test_signatures_are_held_against_one_expression_a_name(spark, monkeypatch):
    """The slow expression is evaluated once for each different name, not for each part."""
    from tallyforge.plans import sourcing, upkeep

    d, seen = "/root/testdata/sf0.001", []
    parts = spark.read.parquet(f"{d}/part.parquet")
    for plan, name in ((sourcing, "stored_signatures"), (upkeep, "index_upkeep")):
        monkeypatch.setattr(plan, "dealt", lambda df: seen.append(df) or df)
        assert plan.QUERIES[name](spark, d).count() > 0
        assert seen[-1].count() <= 2 * parts.select("p_name").distinct().count() < parts.count()
