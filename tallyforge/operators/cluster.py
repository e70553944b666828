"""Duplicate and analogue groups of catalogue items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.catalog import delta
from tallyforge.operators.graph import components, saved
from tallyforge.operators.matching import symmetric


def keyed(items: DataFrame) -> DataFrame:
    """Active items with type_norm, size_key (of the size, else diameter x length) and name_key."""
    d, n = F.trim(T.text("diameter")), F.trim(T.text("length"))
    size = T.first(F.trim(T.text("size")), F.when((d != "") & (n != ""), F.concat(d, F.lit("x"), n)).otherwise(d))
    return items.where("is_active").withColumns({"type_norm": T.clean("item_type"), "size_key": T.size_key(size), "name_key": T.name_key("name"), "std": F.trim(T.text("standard_key"))})


def duplicate_links(items: DataFrame) -> DataFrame:
    """(a, b, reason, detail) that connect items of equal type, size and name whose standards do not differ.

    An item without a standard is linked with every one of its key, so each item is linked with the
    key's first item without a standard, or else with the first of its own standard: the same groups
    as by all pairs, in as many rows as items.
    """
    k = keyed(items).where("type_norm <> '' AND size_key <> '' AND name_key <> ''")
    key = ["type_norm", "size_key", "name_key"]
    free = k.where("std = ''").groupBy(*key).agg(F.min("item_id").alias("free"))
    own = k.groupBy(*key, "std").agg(F.min("item_id").alias("same"))
    out = k.join(own, [*key, "std"]).join(free, key, "left")
    hub = F.coalesce("free", "same")
    return out.where(hub != F.col("item_id")).select(F.least("item_id", hub).alias("a"), F.greatest("item_id", hub).alias("b"), F.lit("duplicate").alias("reason"), F.concat_ws(" | ", *key).alias("detail")).distinct()


def duplicate_pairs(items: DataFrame) -> DataFrame:
    """All pairs a < b of duplicates, for reports on keys that are known to be small."""
    k = keyed(items).where("type_norm <> '' AND size_key <> '' AND name_key <> ''").select("type_norm", "size_key", "name_key", "std", "item_id")
    other = k.select("type_norm", "size_key", "name_key", F.col("std").alias("std2"), F.col("item_id").alias("b"))
    pairs = k.join(other, ["type_norm", "size_key", "name_key"]).where("item_id < b AND (std = '' OR std2 = '' OR std = std2)")
    return pairs.select(F.col("item_id").alias("a"), "b", F.lit("duplicate").alias("reason"), F.concat_ws(" | ", "type_norm", "size_key", "name_key").alias("detail"))


def analog_pairs(items: DataFrame, equivalents: DataFrame) -> DataFrame:
    """(a, b, reason, detail): items of equal type and size whose standards are equivalent, each pair once."""
    k = keyed(items).where("type_norm <> '' AND size_key <> '' AND std <> ''").select("type_norm", "size_key", "std", "item_id")
    near = k.join(symmetric(equivalents).select(F.col("a").alias("std"), F.col("b").alias("std2")), "std")
    other = k.select("type_norm", "size_key", F.col("std").alias("std2"), F.col("item_id").alias("b"))
    pairs = near.join(other, ["type_norm", "size_key", "std2"]).where("item_id < b")
    detail = F.concat(F.col("std"), F.lit(" ↔ "), F.col("std2"), F.lit(" | "), F.col("type_norm"), F.lit(" | "), F.col("size_key"))
    return pairs.select(F.col("item_id").alias("a"), "b", F.lit("analog").alias("reason"), detail.alias("detail")).dropDuplicates(["a", "b"])


def analog_links(items: DataFrame, equivalents: DataFrame) -> DataFrame:
    """(a, b, reason, detail) that connect what analog_pairs() connects, two rows an item and analogue: its first and last partner, which also say all details."""
    k = keyed(items).where("type_norm <> '' AND size_key <> '' AND std <> ''").select("type_norm", "size_key", "std", "item_id")
    ends = k.groupBy("type_norm", "size_key", F.col("std").alias("std2")).agg(F.array(F.min("item_id"), F.max("item_id")).alias("ends"))
    near = k.join(symmetric(equivalents).select(F.col("a").alias("std"), F.col("b").alias("std2")), "std")
    pairs = near.join(ends, ["type_norm", "size_key", "std2"]).withColumn("b", F.explode(F.array_distinct("ends"))).where("item_id <> b")
    first = F.col("item_id") < F.col("b")
    detail = F.concat(F.when(first, F.col("std")).otherwise(F.col("std2")), F.lit(" ↔ "), F.when(first, F.col("std2")).otherwise(F.col("std")), F.lit(" | "), F.col("type_norm"), F.lit(" | "), F.col("size_key"))
    return pairs.select(F.least("item_id", "b").alias("a"), F.greatest("item_id", "b").alias("b"), F.lit("analog").alias("reason"), detail.alias("detail")).distinct()


def groups(items: DataFrame, edges: DataFrame, edge_columns=("a", "b")) -> DataFrame:
    """(item_id, group_id, group_size) of items that have company; group_id is the smallest id."""
    found = components(edges.select(F.col(edge_columns[0]).alias("a"), F.col(edge_columns[1]).alias("b")))
    members = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
    sizes = members.groupBy("component").agg(F.count("*").alias("group_size"))
    return members.join(sizes, "component").select(F.col("id").alias("item_id"), F.col("component").alias("group_id"), "group_size")


def all_links(items: DataFrame, equivalents: DataFrame) -> DataFrame:
    """duplicate_links() and analog_links()."""
    return duplicate_links(items).unionByName(analog_links(items, equivalents))


def groups_after(before: DataFrame, items_before: DataFrame, items_after: DataFrame, equivalents: DataFrame) -> DataFrame:
    """groups() of items_after by all_links(), from before = groups() of items_before: (item_id, group_id, group_size, again).

    Items that came, went or changed touch the items of their new types and sizes and all of their old groups;
    only these are grouped again. Between them and all others there is no link: others share no type and
    size with an item that is new, and old items were linked within their groups. The equivalents are the
    same for both. again: whether the group was made anew.
    """
    put, gone = delta(items_before, items_after, "item_id")
    put, gone = saved(put), saved(gone)
    fresh = keyed(put).select("type_norm", "size_key").distinct()
    near = keyed(items_after).join(fresh, ["type_norm", "size_key"], "left_semi").select("item_id")
    touched = saved(put.select("item_id").unionByName(gone).unionByName(near).distinct())
    old = saved(before.join(touched, "item_id", "left_semi").select("group_id").distinct())
    members = touched.unionByName(before.join(old, "group_id", "left_semi").select("item_id")).distinct()
    some = saved(items_after.join(members, "item_id", "left_semi"))
    made = groups(some, all_links(some, equivalents)).withColumn("again", F.lit(True))
    return before.join(old, "group_id", "left_anti").select("item_id", "group_id", "group_size").withColumn("again", F.lit(False)).unionByName(made)


def elect_parent(members: DataFrame, items: DataFrame) -> DataFrame:
    """members with role: the parent has the smallest priority (none last), a primary folder, the shortest name, the first uid, the smallest id."""
    m = members.join(items.select("item_id", "name", "uid_1c", "folder_priority", "folder_path"), "item_id")
    order = F.struct(F.coalesce("folder_priority", F.lit(999_999)).alias("p"), F.coalesce("folder_path", F.lit("")).startswith("_").alias("side"), F.length(T.text("name")).alias("n"), T.text("uid_1c").alias("u"), F.col("item_id").alias("i"))
    parents = m.groupBy("group_id").agg(F.min(order).alias("best")).select("group_id", F.col("best.i").alias("parent_id"))
    return m.join(parents, "group_id").withColumn("role", F.when(F.col("item_id") == F.col("parent_id"), "parent").otherwise("child"))


def child_reasons(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with reason and detail of a link of theirs: a duplicate before an analogue, then the first detail."""
    ends = edges.select(F.col("a").alias("item_id"), "reason", "detail").unionByName(edges.select(F.col("b").alias("item_id"), "reason", "detail"))
    best = ends.groupBy("item_id").agg(F.min(F.struct((F.col("reason") == "analog").alias("late"), "detail", "reason")).alias("x"))
    return members.join(best.select("item_id", F.col("x.reason").alias("reason"), F.col("x.detail").alias("detail")), "item_id", "left")


def group_report(members: DataFrame, query: str = "", minimum: int = 2) -> DataFrame:
    """Rows of groups with at least `minimum` members, one of whose names holds the query; by size, then the parent's name, with group_num and totals."""
    w = Window.partitionBy("group_id")
    hit = F.max(F.lower(T.text("name")).contains(query.lower())).over(w) if query else F.lit(True)
    kept = members.withColumns({"__hit": hit, "__parent": F.max(F.when(F.col("role") == "parent", F.lower(T.text("name")))).over(w)}).where((F.col("group_size") >= minimum) & F.col("__hit"))
    heads = kept.where("role = 'parent'").select("group_id", F.struct((-F.col("group_size")).alias("s"), F.col("__parent").alias("n"), F.col("group_id").alias("g")).alias("__order"))
    # Groups are numbered by a range-partitioned sort and the counts of earlier partitions, not by one global window.
    ranked = heads.repartitionByRange("__order").sortWithinPartitions("__order").withColumn("__p", F.spark_partition_id())
    ranked = saved(ranked)  # the partitions are read twice, and have to be the same
    ranked = ranked.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy("__order")))
    before = ranked.groupBy("__p").agg(F.count("*").alias("c")).withColumn("__before", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbers = ranked.join(before, "__p").select("group_id", (F.col("__before") + F.col("__i")).alias("group_num"))
    return kept.join(numbers, "group_id").drop("__hit", "__parent")
