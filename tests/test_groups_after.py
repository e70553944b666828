"""Groups after a sync against groups made anew."""

import random

from tallyforge.operators import cluster

SCHEMA = "item_id long, item_type string, size string, diameter string, length string, name string, standard_key string, is_active boolean"


def thing(rng, i):
    return (i, rng.choice(["болт", "гайка", ""]), rng.choice(["M8x20", "M10x40", "M12", ""]), "", "", rng.choice(["один", "два", "три"]), rng.choice(["", "DIN-931", "DIN-933", "ISO-4014"]), rng.random() < 0.9)


def test_groups_after_changes_are_those_made_anew(spark):
    eq = spark.createDataFrame([("DIN-931", "ISO-4014", True)], "src_canonical string, dst_canonical string, is_active boolean")
    seen = set()
    for seed in (1, 2):
        rng = random.Random(seed)
        first = {i: thing(rng, i) for i in range(30)}
        later = {i: x for i, x in first.items() if i not in (4, 9)} | {i: thing(rng, i) for i in (2, 11, 40, 41)}
        before, after = (spark.createDataFrame(list(x.values()), SCHEMA) for x in (first, later))
        old = cluster.groups(before, cluster.all_links(before, eq))
        got = cluster.groups_after(old, before, after, eq).collect()
        want = cluster.groups(after, cluster.all_links(after, eq)).collect()
        assert sorted((r["item_id"], r["group_id"], r["group_size"]) for r in got) == sorted(map(tuple, want)) != []
        seen |= {r["again"] for r in got}
    assert seen == {True, False}
