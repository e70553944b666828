"""Set-similarity joins with prefix filters.

Two sets with a Jaccard similarity of t or more have a token in common among the first n - ceil(t * n) + 1
tokens of each, n its size, in any one order of all tokens; in an order by rarity few rows share those.
Only these prefixes are joined, and a pair met there goes on if its sizes and the places of the token leave
room for enough common tokens. What remains is verified on the whole sets.

Rarity is counted in BUCKETS hash buckets of tokens, so that what tasks need of it has a fixed size. Tokens
that share a bucket are ordered by their hashes: the order is the same everywhere, and collisions cost time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import setblocks
from tallyforge.operators import similarity as S
from tallyforge.operators.graph import saved, ship

BUCKETS = 1 << 18
_SLACK = 1e-9


def hashed(df: DataFrame, key: str, tokens: str = "tokens", block: list[str] = ()) -> DataFrame:
    """(key, block columns, hashes): the different tokens of each row as 64-bit hashes; rows without tokens go."""
    own = df.select(key, *block, F.array_distinct(F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.xxhash64(t))).alias("hashes"))
    return own.where(F.size("hashes") > 0)


def rarity(*sides: DataFrame):
    """How many rows have a token of each bucket, sent to all tasks: BUCKETS numbers."""
    counts = np.zeros(BUCKETS, np.int64)
    every = None
    for df in sides:
        own = df.select(F.explode("hashes").alias("h"))
        every = own if every is None else every.unionByName(own)
    for r in every.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n")).toArrow().to_batches():
        counts[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return sides[0].sparkSession.sparkContext.broadcast(counts)


def prefix_length(size, threshold: float):
    """How many first tokens of a set of so many are joined."""
    return size - np.ceil(threshold * size - _SLACK).astype(np.int64) + 1


def prefixes(df: DataFrame, threshold: float, counts) -> DataFrame:
    """The columns of df but hashes, with size, token and place of each token of the prefix."""
    kept = [c for c in df.columns if c != "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(kept))
            size, h = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, counts.value[h & (BUCKETS - 1)], row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            first = place < np.repeat(prefix_length(size, threshold), size)
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(len(kept))], pa.array(size[row[first]].astype(np.int32)), pa.array(h[order][first]), pa.array(place[first].astype(np.int32))], [*kept, "size", "token", "place"])

    ship(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(kept).schema)
    return df.select(*kept, "hashes").mapInArrow(run, f"{kinds}, size int, token long, place int")


def candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float, block: list[str], counts) -> DataFrame:
    """(left_id, right_id): pairs whose prefixes meet and whose sizes and places allow the threshold; all pairs that reach it are among them."""
    l = prefixes(left, threshold, counts).withColumnsRenamed({"size": "__n", "place": "__i"})
    r = prefixes(right, threshold, counts).withColumnsRenamed({"size": "__m", "place": "__j"})
    n, m = F.col("__n"), F.col("__m")
    sizes = F.least(n, m) >= threshold * F.greatest(n, m) - _SLACK
    most = F.least(n - F.col("__i"), m - F.col("__j"))
    needed = F.lit(threshold / (1 + threshold)) * (n + m) - 1e-6
    return l.join(r, ["token", *block]).where(sizes & (most >= needed)).select(left_id, right_id).distinct()


def similar_sets(left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float, tokens: str = "tokens", block: list[str] = ()) -> DataFrame:
    """(left_id, right_id, shared, jaccard) of all pairs with a Jaccard similarity of `threshold` (over 0) or more, within equal block columns.

    The same pairs as token_join() gives from the threshold on. Sets are those of the different tokens, null
    ones left out; an empty or null set is similar to none; rows with a null block meet nothing. Ids tell rows
    apart on each side. Empty tables give no rows; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0 and up to 1")
    block = list(block)
    l, r = saved(hashed(left, left_id, tokens, block)), saved(hashed(right, right_id, tokens, block))
    return verified(candidates(l, r, left_id, right_id, threshold, block, rarity(l, r)), l, r, left_id, right_id).where(F.col("jaccard") >= threshold - _SLACK)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """pairs with shared and jaccard of their whole sets."""
    both = pairs.join(left.select(left_id, F.col("hashes").alias("__l")), left_id).join(right.select(right_id, F.col("hashes").alias("__r")), right_id)
    out = both.select(left_id, right_id, F.size(F.array_intersect("__l", "__r")).cast("long").alias("shared"), (F.size("__l") + F.size("__r")).alias("__s"))
    return out.select(left_id, right_id, "shared", (F.col("shared") / (F.col("__s") - F.col("shared"))).alias("jaccard"))


def nearest_sets(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int, least: float = 0.3, tokens: str = "tokens", block: list[str] = (), places: int | None = None, other: bool = False) -> DataFrame:
    """(left_id, right_id, shared, jaccard, rank): each left row's k most similar right rows from `least` on, ties by the smaller right id.

    Different sets meet in blocks (setblocks), and rows of equal sets share what theirs find. places: decimals to
    which similarities are rounded before they are ranked. other: a row is no partner of the same id. Rows and
    blocks as for similar_sets(); ids are whole numbers.
    """
    block = list(block)
    (l, rows), (r, members) = setblocks.distinct_sets(left, left_id, block, tokens), setblocks.distinct_sets(right, right_id, block, tokens)
    most = k + 1 if other else k
    # Of equal right sets the first rows alone can be among the nearest.
    few = S.top_k(members.select(F.col(right_id), F.col("set_id").alias("__r")), "__r", [F.col(right_id)], most, "__n").drop("__n")
    sets = lambda df, name: saved(hashed(df, "set_id", "tokens", block).withColumnRenamed("set_id", name))
    found = setblocks.nearest(sets(l, "__l"), sets(r, "__r"), "__l", "__r", most, least, block, places)
    first = S.top_k(found, "__l", [F.desc("jaccard"), F.col("__r")], most).drop("rank")
    first = S.top_k(first.join(few, "__r"), "__l", [F.desc("jaccard"), F.col(right_id)], most).drop("rank", "__r")
    out = rows.select(F.col(left_id), F.col("set_id").alias("__l")).join(first, "__l")
    out = out.where(F.col(left_id) != F.col(right_id)) if other else out
    return S.top_k(out.select(left_id, right_id, "shared", "jaccard"), left_id, [F.desc("jaccard"), F.col(right_id)], k)


def similarity_classes(df: DataFrame, key: str, threshold: float, tokens: str = "tokens") -> DataFrame:
    """(key, class_id, links) of every row: rows of equal token sets are one class, named after its smallest id; links counts the other rows that are as similar as the threshold, equal ones too.

    Only classes meet, in blocks (setblocks), and their links are counted there: neither copies nor similar classes make pairs. A row without tokens is a class of its own without links.
    """
    sets, rows = setblocks.distinct_sets(df, key, tokens=tokens)
    own = saved(sets.select("set_id", "size", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")))
    near = setblocks.near_counts(own, own.withColumnRenamed("set_id", "other"), "set_id", "other", threshold)
    known = rows.join(near.select("set_id", (F.col("near") - 1).alias("links")), "set_id").select(key, F.col("set_id").alias("class_id"), "links")
    alone = df.where(~F.exists(F.coalesce(tokens, F.array().cast(df.schema[tokens].dataType)), lambda t: t.isNotNull())).select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("links"))
    return known.unionByName(alone)


def band_recall(left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float) -> DataFrame:
    """(left_id, near, found) of left rows that have tokens: how many right rows are as similar as the threshold, and how many of these lsh_join() finds, as their bands meet. Pairs are counted in blocks of different sets."""
    (l, rows), (r, _) = (setblocks.distinct_sets(df, key) for df, key in ((left, left_id), (right, right_id)))
    l, r = saved(S.banded(l.withColumnRenamed("set_id", "__l"), "__l")), saved(S.banded(r.withColumnRenamed("set_id", "__r"), "__r", ["size"]))
    got = setblocks.near_counts(l, r, "__l", "__r", threshold)
    return rows.join(got.withColumnRenamed("__l", "set_id"), "set_id").select(left_id, "near", "found")
