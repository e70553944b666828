"""The rule index against every rule on every text, and patterns of Python in Java."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import seeds
from tallyforge.operators import rule_index as RI

SCHEMA = "id long, kind string, pattern string, match string, priority int, active boolean, name string, code string, gram string"


def every_rule_on_every_text(texts, rules):
    best = {}
    for key, text in texts:
        low = (text or "").lower()
        for i, kind, pattern, match, priority, active, name, code, _ in rules:
            if active is False or not pattern:
                continue
            p, part = pattern.lower(), 0
            match = match or "contains"
            try:
                hit = {"contains": lambda: p in low, "term": lambda: p in low, "exact": lambda: p in re.split(r"[\s,;/()]+", low), "regex": lambda: bool(re.search(p, low))}[match]()
            except re.error:
                continue
            if match == "term" and hit:
                part = 0 if re.search(rf"\b{re.escape(p)}\b", low) else 1
            if hit:
                kind = kind or ""
                own = (part, -(priority or 0), i)
                if (key, kind) not in best or own < best[key, kind][0]:
                    best[key, kind] = own, name, code
    return sorted((k, kind, part, -p, i, name, code) for (k, kind), ((part, p, i), name, code) in best.items())


def random_rules(rng, n):
    words = ["болт", "гайка м", "din 9", "а2", "zn", "x", "м10", "шайба плоская", "кг", "ё"]
    patterns = {
        "contains": lambda: rng.choice(words) + rng.choice(["", " ", "1", rng.choice(words)]), "exact": lambda: rng.choice(words).strip() + rng.choice(["", "1"]), "term": lambda: rng.choice(words).strip(),
        "regex": lambda: rng.choice([r"м\d+", r"(болт|гайка)\s*м", r"din\s+9\d", r"(?:zn|цинк)+", r"\d+x\d+", r"[", r"^$", r"(?<!\d)10(?!\d)", r"ша(й)?ба", r"(a|bc)?x", r"к{2,}", r"(?i)кг$", r"ш.*я", r"(?P<q>\d)"]),
    }
    out = []
    for i in range(n):
        match = rng.choice(["contains", "exact", "regex", "term", None])
        p = patterns[match or "contains"]()
        out.append((i, rng.choice(["k1", "k2", None]), rng.choice([p, p, p.upper(), None, ""]) if i % 9 == 0 else p, match, rng.choice([None, 0, 5, -1]), rng.choice([None, True, True, False]), f"n{i}", None, "x"))
    return out


def random_texts(rng, n):
    words = ["Болт", "гайка", "м10", "М12x40", "DIN 933", "Zn", "а2", "шайба плоская", "кг", "10", "ккк", "Ё", "x"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "болт " * 20_000 + "м77")]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    rules, texts = random_rules(rng, 80), random_texts(rng, 150)
    return rules, texts, spark.createDataFrame(rules, SCHEMA).repartition(3), spark.createDataFrame(texts, "row_id long, text string").withColumn("kind", F.lit("clash")).repartition(4)


@pytest.mark.parametrize("sent", [RI.SENT_BYTES, 0])
def test_the_index_finds_what_all_rules_find(made, sent, monkeypatch):
    rules, texts, r, t = made
    monkeypatch.setattr(RI, "BLOCK", 2)
    if not sent:
        monkeypatch.setattr(RI, "SENT_BYTES", 0)  # nothing is sent to tasks
    got = sorted(tuple(x) for x in RI.first_rules(t, r, sent_bytes=sent).collect())
    want = every_rule_on_every_text(texts, rules)
    assert len(want) > 100 and got == want


def test_a_change_of_rules_is_redecided(spark, made):
    rules, texts, r, t = made
    rng = random.Random(5)
    after = [(*x[:4], 7, *x[5:]) if x[0] % 11 == 3 else x for x in rules if x[0] % 10 != 4] + [(1000 + i, "k1", rng.choice(["болт", "м1", "гайка"]), "contains", 9, True, "new", "c", "x") for i in range(2)]
    r2 = spark.createDataFrame(after, SCHEMA)
    got = RI.redecided(t, RI.first_rules(t, r), r, r2).collect()
    assert sorted(tuple(x)[:-1] for x in got) == every_rule_on_every_text(texts, after)
    assert {x["again"] for x in got} == {True, False}


def test_equal_texts_are_tried_once_and_rules_in_all_tasks(spark, made):
    rules, texts, r, t = made
    tasks = spark.sparkContext.defaultParallelism
    assert RI.prepared(r.coalesce(1)).rdd.getNumPartitions() >= tasks
    twice = t.unionByName(t).where("text IS NOT NULL").coalesce(1)
    got = RI.first_rules(twice, r, key="text", text="text")
    assert got.rdd.getNumPartitions() >= tasks
    names = {(x, x) for _, x in texts if x is not None}
    assert sorted(tuple(x) for x in got.collect()) == every_rule_on_every_text(names, rules)
    after = r.where("id % 10 <> 4")
    again = RI.redecided(twice, got, r, after, key="text", text="text")
    assert sorted(tuple(x)[:-1] for x in again.collect()) == every_rule_on_every_text(names, [x for x in rules if x[0] % 10 != 4])


def test_no_rules_or_texts(spark, made):
    _, _, r, t = made
    assert RI.first_rules(t, r.where("false")).count() == 0 and RI.first_rules(t.where("false"), r).count() == 0


def test_default_rules_as_the_chain_says(spark):
    own = seeds.default_dictionary()
    texts = ["Болт М12х40 8.8 оцинк", "гайка нерж а2-70", "Шайба", "винт 10,9 zinc", "анкер .88 б/п", "класс прочности 12.9 никель", "хром", "кл.пр. 5.8"]
    t = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    rules = spark.createDataFrame([(r.id, r.kind, r.pattern, r.match, r.priority, r.name, r.code) for r in own.rules if r.kind != "size"], RI.RULE)
    got = {(x["row_id"], x["kind"]): x["name"] for x in RI.first_rules(t, rules).collect()}
    for r in t.select("row_id", X.detect("text", own.of("coating")).alias("coating"), X.detect("text", own.of("strength")).alias("strength")).collect():
        assert r["coating"] == got.get((r["row_id"], "coating"), "") and r["strength"] == got.get((r["row_id"], "strength"), "")


@pytest.mark.parametrize("pattern, held", [
    ("болт", ["болт"]), (r"din\s*931", ["din"]), (r"(болт|гайка) м", ["болт", "гайка"]), (r"\d+", []), (r"a?b+", ["b"]), (r"x(?:yz)w", ["xyzw"]), (r"(a|b*)", []), (r"(?<!foo)bar", ["bar"]), ("(", None),
])
def test_literals_of_patterns(pattern, held):
    assert RI.literals(pattern, "regex") == held


def test_grams_of_texts_do_not_touch():
    place, h = RI.grams(["abcd", "", "bc", "cd𝄞"], (2,))
    one = {t: RI.grams([t], (2,))[1].tolist() for t in ("ab", "bc", "cd", "d𝄞")}
    assert {(p, x) for p, x in zip(place.tolist(), h.tolist())} == {(0, one["ab"][0]), (0, one["bc"][0]), (0, one["cd"][0]), (2, one["bc"][0]), (3, one["cd"][0]), (3, one["d𝄞"][0])}
    assert RI.grams([])[0].tolist() == [] and RI.grams(["", "a"], (4,))[0].tolist() == []


@pytest.mark.parametrize("pattern, texts", [
    (r"(?P<a_b>x)(?P=a_b)", ["xx", "xy"]), (r"[[]x", ["[x", "x"]), (r"x(?#note)y", ["xy", "x"]), (r"[]a]b", ["]b", "ab", "b"]), (r"[^]&&]", ["]", "&", "a"]), (r"a{,2}b", ["b", "aab"]), (r"a{b", ["a{b", "ab"]), (r"b\Z", ["b", "bc"]), (r"(?a)\w", ["a", " "]),
])
def test_patterns_mean_the_same_in_java(spark, pattern, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(X.java(pattern)).alias("x")).collect()
    assert [r["x"] for r in got] == [bool(re.search(pattern, t)) for t in texts]


def test_rules_that_java_cannot_read_never_match(spark):
    d = X.Dictionary((X.Rule(1, "coating", "(?(1)a|b)", "regex", "c", "cond"), X.Rule(2, "coating", "(", "regex", "c", "open"), X.Rule(3, "coating", "zn", "contains", "z", "zinc"), X.Rule(4, "coating", r"(x)(?(1)y|z)", "regex", "c", "cond")))
    assert [r.id for r in d.of("coating")] == [3]
    assert spark.createDataFrame([("zn",)], "t string").select(X.detect("t", d.of("coating"))).first()[0] == "zinc"
