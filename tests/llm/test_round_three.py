"""Sharding, hard negatives and the manifest against plain versions of themselves."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hard_negatives, manifest, sharding
from tallyforge.llm.numbering import numbered

# Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 97, 1000])
def test_positions_are_a_permutation_and_can_be_undone(spark, n):
    p = sharding.permutation(spark, n, "s")
    rows = spark.range(n).select("id", p.position(F.col("id")).alias("at")).withColumn("back", p.row(F.col("at"))).collect()
    assert sorted(r["at"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_the_permutation_is_the_plain_one(spark):
    n = 997
    p = sharding.permutation(spark, n, "plain")
    a, b = p.halves

    def fold(x):
        return (x >> 29) & sharding.MASK ^ (x >> 13) & sharding.MASK

    def step(x):
        l, r = divmod(x, b)
        for k, m1, m2, size in p.keys():
            l, r = r, (l + fold(fold((r ^ k) * m1) * m2)) % size
        return l * b + r

    def walk(x):
        x = step(x)
        while x >= n:
            x = step(x)
        return x

    assert a * b > n
    got = {r["id"]: r["at"] for r in spark.range(n).select("id", p.position(F.col("id")).alias("at")).collect()}
    assert got == {i: walk(i) for i in range(n)}


def test_neighbours_part_and_seeds_differ(spark):
    n = 5000
    at = {s: [r[0] for r in spark.range(n).select(sharding.permutation(spark, n, s).position(F.col("id"))).collect()] for s in ("a", "b")}
    together = sum(x % 8 == y % 8 for x, y in itertools.pairwise(at["a"]))
    assert 0.09 < together / n < 0.16 and sum(x == y for x, y in zip(at["a"], at["b"])) < 10
    counts = np.histogram2d(np.arange(n), at["a"], bins=10)[0]
    assert ((counts - n / 100) ** 2 / (n / 100)).sum() < 160  # chi-square with 81 degrees of freedom


def test_a_large_table_needs_few_walks(spark):
    p = sharding.permutation(spark, 10**12 + 39, "x")
    assert p.walks < 10
    row = spark.range(1).select(p.row(p.position(F.lit(10**12 + 38))).alias("r")).first()["r"]
    assert row == 10**12 + 38


def test_places_of_all_rows_whatever_their_partitions(spark):
    rows = [(None, None, "x"), (1, "b", None), (1, "a", "y"), (2, None, "z"), (2, None, "z"), (3, "", "")] + [(10, "same", "c")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, __position string")
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    seen = []
    for parts in (1, 7):
        got = sharding.assign(df.repartition(parts), order, 3, "q").drop("row_number").collect()
        assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "__position", "shard", "slot"}
        for s in range(3):
            own = sorted(r["slot"] for r in got if r["shard"] == s)
            assert own == list(range(len(own))) and len(own) in (len(rows) // 3, len(rows) // 3 + 1)
        seen.append(sorted(map(str, got)))
    assert seen[0] == seen[1]
    assert sharding.assign(df.limit(0), order).count() == 0
    with pytest.raises(ValueError, match="taken"):
        sharding.assign(df.withColumn("slot", F.lit(1)), order)


def test_shards_are_written_in_order(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), 50).alias("text"))
    sharding.write_shards(sharding.assign(df, [F.col("doc_id")], 4), str(tmp_path / "out"))
    one = [r["slot"] for r in spark.read.parquet(str(tmp_path / "out" / "shard=2")).collect()]
    assert sorted(one) == list(range(25))
    assert spark.read.parquet(str(tmp_path / "out")).where("shard = 2").count() == 25


def test_one_key_fills_several_partitions(spark):
    df = spark.range(20000).select(F.lit(5).alias("k"))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        got = numbered(df.repartition(8), [F.col("k")], "i")
    finally:
        spark.conf.unset(merge)
    assert sorted(r["i"] for r in got.collect()) == list(range(20000)) and len(got.inputFiles()) > 1


def test_sharding_plan_is_native(spark):
    df = sharding.assign(spark.range(10).withColumnRenamed("id", "doc_id"), [F.col("doc_id")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Hard negatives


def mined_plainly(rows, positives=5, negatives=3):
    use = [(i, l, [math.floor(256 * float(x)) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    use = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in use]
    out = []
    for a, la, va in [r for r in use if r[0] % 50 == 0]:
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, l == la) for i, l, v in use if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, r, i, -s, -n) for r, (n, i, _) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, score string, w int"


def mine_all(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, label, **options).collect())


def test_hard_negatives_of_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(0.2, 0.3, 8)]) for i in range(400)]
    want = mined_plainly(rows)
    assert len(want) > 50 and mine_all(spark, rows) == want
    assert mine_all(spark, rows, block=3) == want


def test_hard_negatives_of_ties_and_bad_rows(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.choice([0.5, 0.5, 1.0]), 0.25]) for i in range(300)]  # few scores, so thresholds tie
    rows += [(50, 1, [0.5, 0.25])] * 2 + [(301, 0, [0.5, 0.25])] * 5  # repeated rows
    rows += [(350, None, [1.0, 1.0]), (400, 1, None), (450, 1, [float("nan"), 1.0]), (500, 1, [None, 1.0]), (550, 2, [float("inf"), 0.0]), (None, 1, [1.0, 1.0]), (600, 1, []), (700, 2, [1.0, 1.0, 1.0])]
    want = mined_plainly(rows)
    assert want and mine_all(spark, rows) == want


def test_hard_negatives_of_wide_scores_and_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 2)), [float(np.float32(x)) for x in rng.normal(3e4, 2e4, 3)]) for i in rng.integers(-(2**50), 2**50, 200) // 50 * 50 + rng.integers(0, 2, 200)]
    want = mined_plainly(rows)
    assert want and mine_all(spark, rows) == want


def test_hard_negatives_of_nothing(spark):
    assert mine_all(spark, []) == [] and mine_all(spark, [(1, 1, [1.0])]) == [] and mine_all(spark, [(50, 1, [1.0])]) == []
    with pytest.raises(ValueError, match="64 bits"):
        mine_all(spark, [(50, 1, [1e30]), (51, 1, [1.0])])


# Manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_of(leaves):
    """(root, [(left, right), ...] of each leaf)."""
    sides, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            s = p // 8 * 8
            sides[i].append(("".join(level[s:p]), "".join(level[p + 1 : s + 8])))
        level, at = [sha(*level[s : s + 8]) for s in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], sides


def manifest_plainly(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    out, trees = [], {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, text, lang, source, n in rows:
        fake = text.translate(low) if text and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else text
        trees.setdefault(lang, []).append(((d is not None, d or 0), sha(said(d, source, lang, n, text)), sha(said(d, source, lang, n, fake))))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {n: tree_of([x[1] for x in sorted(trees[n])]) for n in names}
    root, top = tree_of([grown[n][0] for n in names])
    for n, above in zip(names, top):
        for (order, leaf, fake), own in zip(sorted(trees[n]), grown[n][1]):
            h = fake
            for a, b in own + above:
                h = sha(a, h, b)
            out.append((order[1] if order[0] else None, leaf, grown[n][0], root, sha(*[a + b for a, b in own + above]), h, h == root))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, level int, leaf string"


def made(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "t", 1, "l") for r in rows], DOCS).repartition(parts)
    got = manifest.manifest(df, manifest.FIELDS, "lang", "doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, "text")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_manifest_of_many_rows(spark):
    rng = random.Random(4)
    rows = [(i * 3, rng.choice(["Ab", "cd", "É漢 X", "", None]), rng.choice(["en", "en", "en", "de", "z", None]), rng.choice(["s", None]), rng.choice([None, i])) for i in range(1500)]
    rows += [(None, "A", "en", None, None)] * 3 + [(30, "Twice", "en", "s", 1)] * 20 + [(7, "Q" * 50_000, "one", "s", 5)]
    want = manifest_plainly(rows)
    assert made(spark, rows) == want and made(spark, rows, 1) == want
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_manifest_of_one_language(spark, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert made(spark, rows) == manifest_plainly(rows)


def test_manifest_of_many_languages(spark):
    rows = [(i, f"T{i}", f"l{i % 600}", "s", i) for i in range(700)]
    assert made(spark, rows) == manifest_plainly(rows)


def test_manifest_of_nothing(spark):
    assert made(spark, []) == []


def test_fragments_merge_in_any_order():
    rng = random.Random(5)
    leaves = [(0, i, 100, sha(str(i))) for i in range(100)] + [(1, i, 9, sha(f"b{i}")) for i in range(9)] + [(2, 0, 1, sha("c"))]
    seen = set()
    for _ in range(20):
        rng.shuffle(leaves)
        cuts = sorted(rng.sample(range(1, len(leaves)), 4))
        parts = [leaves[a:b] for a, b in zip([0, *cuts], [*cuts, len(leaves)])]
        runs = []
        while True:
            left = []
            for part in parts:
                forest = manifest.Forest(3)
                for x in part:
                    runs += forest.add(x[0], 0, *x[1:]) if len(x) == 4 else forest.add(*x[1:5], x[5][0])
                left.append(list(forest.rest()))
            if not any(left):
                break
            rng.shuffle(left)
            parts = [list(itertools.chain(*left[i : i + 2])) for i in range(0, len(left), 2)]
        seen.add(tuple(sorted((r[1], r[2], r[3], tuple(r[5])) for r in runs)))
    assert len(seen) == 1


# Long roles and texts in chats


def test_long_roles_and_texts_read_back(spark):
    from tallyforge.llm import chat_format

    odd = "\\" * 10_000 + "\n" * 10_000 + "<|end|>[INST]" * 2_000
    turns = [(1, 0, "r" * 100_000, "t" * 100_000), (1, 1, odd, odd), (1, 2, "assistant", "x\n" * 50_000), (1, 3, "\\\n\\", ""), (2, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r["turns"] for r in chat_format.format_conversations(df).select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]] == [(r, t) for _, _, r, t in turns[:4]]
    assert [(t["role"], t["text"]) for t in got[2]] == [("", "")]


# Vectors without links, and names that are taken


def test_vectors_without_links_are_searched_exactly(spark, caplog):
    import logging

    from tallyforge.llm import embedding_dedup

    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 12)))]
    with caplog.at_level(logging.INFO, logger=embedding_dedup.log.name):
        got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["n_links"] == 0 and r["kept"] for r in got) and len(got) == 60
    assert "exact search" in caplog.text


def test_one_of_each_keeps_columns_of_any_name(spark):
    from tallyforge.llm import minhash

    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, 77), (2, text, 88), (3, "other words altogether in this text", 99)], "doc_id long, text string, __row long")
    assert sorted(tuple(r) for r in minhash.one_of_each(df).collect()) == [(1, text, 77), (3, "other words altogether in this text", 99)]
