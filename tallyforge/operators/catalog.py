"""Catalogue maintenance: sync against a full feed, folder hierarchy, master groups, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.graph import saved, unsaved


def sync(old: DataFrame, new: DataFrame, keys: list[str] = ("uid", "char"), values: list[str] = ("name",)) -> DataFrame:
    """Full feed against the stored items: keys, action (created, updated, unchanged, deactivated, inactive), values and is_active afterwards.

    A null key part equals a null one. Items the feed lacks are deactivated if they were active. The
    feed's last row of a key counts (by its values).
    """
    keys, values = list(keys), list(values)
    norm = {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}
    n = new.withColumns(norm).groupBy(*keys).agg(*[F.max(F.struct(*values)).alias("__new")]).withColumn("__in", F.lit(True))
    o = old.withColumns(norm).select(*keys, F.struct(*values).alias("__old"), F.col("is_active").alias("__was"))
    both = o.join(n, keys, "full_outer")
    action = (
        F.when(F.col("__in").isNull(), F.when(F.col("__was"), "deactivated").otherwise("inactive")).when(F.col("__old").isNull(), "created")
        .when(~F.col("__old").eqNullSafe(F.col("__new")) | ~F.col("__was"), "updated").otherwise("unchanged")
    )
    return both.select(*keys, action.alias("action"), *[F.coalesce(F.col(f"__new.{v}"), F.col(f"__old.{v}")).alias(v) for v in values], F.col("__in").isNotNull().alias("is_active"))


def folder_paths(folders: DataFrame) -> DataFrame:
    """folder_uid, path (root to leaf, ' / '), priority (own, else of the nearest ancestor that has one), level.

    Pointer jumping: each folder knows the stretch up to some ancestor, and takes that ancestor's stretch
    on top of its own, so stretches double and d levels take about log2(d) rounds. A parent that is not
    there ends a path. Folders that are still not done when a stretch would be longer than there are folders
    lead to a cycle: their paths go up one level at a time until a folder repeats.
    """
    base = folders.select("folder_uid", F.coalesce("folder_name", F.lit("")).alias("name"), F.nullif(T.text("parent_uid"), F.lit("")).alias("parent"), F.col("priority").cast("int").alias("own"))
    base = saved(base)
    state = base.select("folder_uid", F.nullif("name", F.lit("")).alias("path"), F.col("own").alias("priority"), F.col("parent").alias("up"), F.lit(1).alias("level"))
    before, open_ = None, F.col("up").isNotNull()
    for _ in range(base.count().bit_length() + 1):
        over = state.select(F.col("folder_uid").alias("up"), F.col("path").alias("__path"), F.col("priority").alias("__priority"), F.col("up").alias("__up"), F.col("level").alias("__level"))
        path = F.nullif(F.concat_ws(" / ", "__path", "path"), F.lit(""))
        state = saved(state.join(over, "up", "left").select("folder_uid", path.alias("path"), F.coalesce("priority", "__priority").alias("priority"), F.col("__up").alias("up"), (F.col("level") + F.coalesce("__level", F.lit(0))).alias("level")))
        unsaved(before)
        before = state
        if state.where(open_).isEmpty():
            break
    done = state.where(~open_).select("folder_uid", F.coalesce("path", F.lit("")).alias("path"), "priority", "level")
    rest = state.where(open_).select("folder_uid").distinct()
    return done if rest.isEmpty() else done.unionByName(_walked(base, base.join(rest, "folder_uid", "left_semi")))


def _walked(base: DataFrame, asked: DataFrame) -> DataFrame:
    """folder_paths() of the asked folders, a level at a time, up to a parent that is not there or was passed before."""
    up = base.select(F.col("folder_uid").alias("next"), F.col("name").alias("up_name"), F.col("parent").alias("up_parent"), F.col("own").alias("up_own"))
    walk = asked.select("folder_uid", F.col("name").alias("path"), F.col("own").alias("priority"), F.col("parent").alias("next"), F.array("folder_uid").alias("seen"))
    walk_table = None
    while True:
        more = walk.join(up, "next", "left")
        ok = F.col("up_name").isNotNull() & ~F.array_contains("seen", F.col("next"))
        walk = more.select(
            "folder_uid", F.when(ok & (F.col("up_name") != ""), F.concat_ws(" / ", "up_name", F.nullif(F.col("path"), F.lit("")))).otherwise(F.col("path")).alias("path"),
            F.coalesce("priority", F.when(ok, F.col("up_own"))).alias("priority"), F.when(ok, F.col("up_parent")).alias("next"), F.when(ok, F.array_append("seen", F.col("next"))).otherwise(F.col("seen")).alias("seen"),
        )
        walk, before = saved(walk), walk_table
        unsaved(before)
        walk_table = walk
        if walk.where("next IS NOT NULL").isEmpty():
            break
    return walk.select("folder_uid", "path", "priority", F.size("seen").alias("level"))


def recomputed_keys(items: DataFrame) -> DataFrame:
    """items with their canonical key computed anew, and whether it changed."""
    return items.withColumn("__key", T.canonical_key("item_type", T.text("standard_key"), "size")).withColumn("changed", ~F.col("canonical_key").eqNullSafe(F.col("__key"))).withColumn("canonical_key", F.col("__key")).drop("__key")


def master_groups(masters: DataFrame, members: DataFrame) -> DataFrame:
    """Active masters with their members, the primary one first: master_item_id, name, n_members, members."""
    m = members.groupBy("master_item_id").agg(F.count("*").alias("n_members"), F.sort_array(F.collect_list(F.struct((~F.col("is_primary")).alias("late"), "onec_guid"))).alias("m"))
    return masters.where("is_active").join(m, "master_item_id", "left").select("master_item_id", "name", F.coalesce("n_members", F.lit(0)).alias("n_members"), F.transform(F.coalesce("m", F.array()), lambda x: x["onec_guid"]).alias("members"))


def member_conflicts(members: DataFrame) -> DataFrame:
    """Members of more than one master."""
    return members.groupBy("onec_guid").agg(F.count_distinct("master_item_id").alias("n_masters")).where("n_masters > 1")


def with_primary(members: DataFrame, master_item_id: int, onec_guid: str) -> DataFrame:
    """members with that one as its master's only primary member."""
    return members.withColumn("is_primary", F.when(F.col("master_item_id") == master_item_id, F.col("onec_guid") == onec_guid).otherwise(F.col("is_primary")))


def search(items: DataFrame, query: str, columns: list[str], order: list[str], limit: int = 20) -> DataFrame:
    """The first `limit` items one of whose columns holds the query, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(T.text(c)).contains(query.lower())
    return items.where(hit).orderBy(*order).limit(limit)


def snapshot_version(items: DataFrame) -> str:
    """A digest that changes with any row, whatever their order; a key for what is derived from them."""
    r = items.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*items.columns)).alias("x")).first()
    return f"{r['n']}-{(r['x'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def delta(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to put into an index and keys to take out of it: new or changed rows, and those that went or changed."""
    b, a = before.select(key, F.xxhash64(*before.columns).alias("__h")), after.withColumn("__h", F.xxhash64(*before.columns))
    return a.join(b, [key, "__h"], "left_anti").drop("__h"), b.join(a.select(key, "__h"), [key, "__h"], "left_anti").select(key)


def refreshed(index: DataFrame, before: DataFrame, after: DataFrame, key: str, build) -> DataFrame:
    """An index (one row a key, made by build(rows)) of `before`, brought to `after`: only rows that are new or changed are built again."""
    put, gone = delta(before, after, key)
    return index.join(gone, key, "left_anti").unionByName(build(put))


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
