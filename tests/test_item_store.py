"""A store that is synced in part against syncs of the whole."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import catalog
from tallyforge.operators.item_store import ItemStore

FEED = "uid string, char string, name string, is_active string"


def test_partial_syncs_are_whole_ones(spark, tmp_path):
    rng = random.Random(4)
    store = ItemStore(spark, str(tmp_path / "store"), buckets=8)
    assert store.version() is None
    feed = {f"u{i}": rng.choice(["a", "b", None, ""]) for i in range(40)}
    whole, files, versions = None, {}, []
    for step in range(4):
        if step == 1:
            feed["u3"], feed["new"] = "changed", "x"
        if step == 2:
            feed.pop("u5")
        if step == 3:
            feed = {}
        rows = [(u, None, n, "clash") for u, n in feed.items()] + ([("u1", "", "zz", "x"), ("u1", None, "aa", "x"), (None, "c", "n", "x")] if feed else [])
        df = spark.createDataFrame(rows, FEED)
        version, changed = store.sync(df)
        old = whole if whole is not None else df.withColumn("is_active", F.lit(True)).where("false")
        full = catalog.sync(old, df)
        want = sorted(map(str, full.drop("action").collect()))
        assert sorted(map(str, store.read().collect())) == want
        assert sorted(map(str, changed.collect())) == sorted(map(str, full.where("action IN ('created', 'updated', 'deactivated')").select("uid", "char", "action", "name", "is_active").collect()))
        now = set(store.read().inputFiles())
        if step in (1, 2):
            assert 0 < len(files[step - 1] - now) <= 2  # other files keep their names
        files[step] = now
        versions.append((version, want))
        if step < 3:
            assert store.sync(df)[0] == version and store.sync(df)[1].count() == 0  # the same feed makes no version
        whole = spark.createDataFrame([tuple(r) for r in full.select("uid", "char", "name", "is_active").collect()], "uid string, char string, name string, is_active boolean")
    assert [v for v, _ in versions] == [0, 1, 2, 3]
    for v, want in versions:  # readers of earlier versions still read them
        assert sorted(map(str, store.read(v).collect())) == want
