"""Prefix-filtered joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import setjoin
from tallyforge.operators import similarity as S

SCHEMA = "id long, tokens array<string>, b string, size int, token string, place int"


def rows_of(rng, n, first=0):
    words = [f"w{i}" for i in range(9)] + ["common", "also"]
    out = [(first + i, [rng.choice(words) for _ in range(rng.randint(1, 8))] + ["common"] * rng.randint(0, 2)) for i in range(n)]
    out += [(first + n, out[0][1]), (first + n + 1, out[0][1][::-1]), (first + n + 2, []), (first + n + 3, None), (first + n + 4, ["w1", None, "w1"])]
    return [(i, t, rng.choice(["x", "y", None]), 1, "t", 2) for i, t in out]


def plain(left, right, threshold, block=False):
    sets = lambda rows: [(i, {t for t in ts or () if t is not None}, b) for i, ts, b, *_ in rows]
    out = {}
    for i, s, b in sets(left):
        for j, t, c in sets(right):
            if s and t and (not block or b is not None and b == c) and len(s & t) >= threshold * len(s | t) - 1e-9:
                out[i, j] = len(s & t) / len(s | t)
    return out


@pytest.mark.parametrize("threshold", [1.0, 0.75, 0.5, 0.2])
@pytest.mark.parametrize("block", [[], ["b"]])
def test_pairs_from_a_threshold_on(spark, threshold, block):
    rng = random.Random(int(threshold * 100))
    left, right = rows_of(rng, 70), rows_of(rng, 90, 1000)
    l = spark.createDataFrame(left, SCHEMA).repartition(3)
    r = spark.createDataFrame(right, SCHEMA).withColumnRenamed("id", "other").repartition(2)
    got = setjoin.similar_sets(l, r, "id", "other", threshold, block=block).collect()
    want = plain(left, right, threshold, bool(block))
    assert (want or threshold == 1) and {(x["id"], x["other"]): pytest.approx(x["jaccard"]) for x in got} == want and len(got) == len(want)


def test_nearest_sets_are_the_first_of_all(spark):
    rng = random.Random(4)
    left, right = rows_of(rng, 60), rows_of(rng, 80, 1000)
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).withColumnRenamed("id", "other")
    got = sorted((x["id"], x["rank"], x["other"], x["jaccard"]) for x in setjoin.nearest_sets(l, r, "id", "other", 3, 0.1, places=2).collect())
    want = []
    for i in {x[0] for x in left}:
        near = sorted((-round(j + 1e-12, 2), b) for (a, b), j in plain(left, right, 0.1).items() if a == i)[:3]
        want += [(i, k, b, -j) for k, (j, b) in enumerate(near, 1)]
    assert got == sorted(want)


def test_copies_make_classes_and_count_as_links(spark):
    rng = random.Random(6)
    rows = rows_of(rng, 40) + [(500 + i, ["a", "b", "c", "d"], None, 1, "t", 2) for i in range(200)] + [(900, ["a", "b", "c", "d", "e"], None, 1, "t", 2)]
    got = {x["id"]: (x["class_id"], x["links"]) for x in setjoin.similarity_classes(spark.createDataFrame(rows, SCHEMA), "id", 0.75).collect()}
    pairs = plain(rows, rows, 0.75)
    sets = {i: frozenset(t for t in ts or () if t is not None) for i, ts, *_ in rows}
    want = {i: (min(j for j in sets if sets[j] == sets[i]) if sets[i] else i, sum(a == i != b for a, b in pairs)) for i in sets}
    assert got == want


def test_empty_tables_and_bad_thresholds(spark):
    df = spark.createDataFrame(rows_of(random.Random(1), 3), SCHEMA)
    none = df.where("false").withColumnRenamed("id", "other")
    assert setjoin.similar_sets(df, none, "id", "other", 0.5).count() == 0 and setjoin.nearest_sets(df, none, "id", "other", 2).count() == 0 and setjoin.similarity_classes(df.where("false"), "id", 0.5).count() == 0
    with pytest.raises(ValueError):
        setjoin.similar_sets(df, none, "id", "other", 0)


def test_small_and_large_blocks_meet_alike(spark, monkeypatch):
    rng = random.Random(2)
    left, right = rows_of(rng, 50), rows_of(rng, 50, 1000)
    some = lambda rows: [x for x in rows if x[1] and None not in x[1]]
    l, r = spark.createDataFrame(some(left), SCHEMA), spark.createDataFrame(some(right), SCHEMA).withColumnRenamed("id", "other")
    want = {k: v for k, v in plain(some(left), some(right), 1e-9, True).items()}
    for most in (0, 300, 10_000):
        monkeypatch.setattr(S, "BLOCK_PAIRS", most)
        got = S.token_join(l.withColumn("tokens", F.array_distinct("tokens")), r.withColumn("tokens", F.array_distinct("tokens")), "id", "other", block=["b"]).collect()
        assert {(x["id"], x["other"]): pytest.approx(x["jaccard"]) for x in got} == want and len(got) == len(want)


def test_rare_tokens_are_joined_first(spark):
    rows = [(i, ["common", "also", "usual", f"r{i}", f"s{i}", f"t{i}"], None, 1, "t", 2) for i in range(300)] + [(900 + i, ["common", "also", "usual", "r7", "s7", f"q{i}"], None, 1, "t", 2) for i in range(2)]
    df = setjoin.hashed(spark.createDataFrame(rows, SCHEMA), "id")
    met = setjoin.candidates(df, df.withColumnRenamed("id", "other"), "id", "other", 0.6, [], setjoin.rarity(df))
    assert met.count() < 400  # of 91,204 pairs that share a token
