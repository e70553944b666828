"""Token-set similarity joins: exact Jaccard through an inverted index, MinHash signatures and LSH bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.graph import ship

PRIME = 4294967311  # the smallest prime above 2**32
PERMUTATIONS, BANDS, BAND_ROWS = 128, 37, 3


def item_tokens(name, item_type=None, size=None, standard=None, n: int = 4) -> Column:
    """Character n-grams of an item's text, with its type and standard if the name lacks them, and SIZE:, TYPE: and STD: marks."""
    kind, key = T.clean(item_type) if item_type is not None else F.lit(""), T.text(standard) if standard is not None else F.lit("")
    parts = F.struct(T.similarity_text(name).alias("norm"), T.similarity_text(kind).alias("own"), T.similarity_text(T.display_standard(key)).alias("std"))
    absent = lambda x, p: F.when((p != "") & ~x["norm"].contains(p), p)
    whole = T.let(parts, lambda x: F.concat_ws(" ", x["norm"], absent(x, x["own"]), absent(x, x["std"])))
    return F.array_union(T.char_ngrams(whole, n), marks(size if size is not None else F.lit(""), kind, key))


def marks(size, kind: Column, key: Column) -> Column:
    s = T.normalize_size(size)
    pairs = (("SIZE:", s), ("TYPE:", kind), ("STD:", key))
    return F.array_compact(F.array(*[F.when(v != "", F.concat(F.lit(m), v)) for m, v in pairs]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


#: Pairs of rows of a block up to which all of them are compared; larger blocks go through the inverted index.
BLOCK_PAIRS = 10_000


def token_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str = "tokens", block: list[str] = ()) -> DataFrame:
    """(left_id, right_id, shared, jaccard) of all pairs that share a token, within equal block columns.

    Rows of a small block meet directly. Larger blocks, and rows without a block, use an inverted index:
    both sides are exploded and joined on the token; the pair's size is counted with partial aggregation.
    Tokens that very many rows have make many pairs: where a threshold is known, use setjoin.similar_sets().
    """
    block = list(block)
    if not block:
        return _by_index(left, right, left_id, right_id, tokens, block)
    many = left.groupBy(*block).agg(F.count("*").alias("__l")).join(right.groupBy(*block).agg(F.count("*").alias("__r")), block)
    large = many.where(F.col("__l") * F.col("__r") > BLOCK_PAIRS).select(*block)
    whole = lambda df, key, name: df.select(key, *block, F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))).alias(name))
    small = whole(left, left_id, "__lt").join(large, block, "left_anti").join(whole(right, right_id, "__rt"), block)
    both = small.select(left_id, right_id, F.size(F.array_intersect("__lt", "__rt")).cast("long").alias("shared"), (F.size("__lt") + F.size("__rt")).alias("__s")).where("shared > 0")
    direct = both.select(left_id, right_id, "shared", (F.col("shared") / (F.col("__s") - F.col("shared"))).alias("jaccard"))
    return direct.unionByName(_by_index(left.join(large, block, "left_semi"), right.join(large, block, "left_semi"), left_id, right_id, tokens, block))


def _by_index(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, block: list[str]) -> DataFrame:
    def exploded(df, key, size):  # tokens meet by their 64-bit hashes
        return df.select(F.col(key), F.size(tokens).alias(size), *block, F.explode(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))).alias("__t"))

    lt, rt = exploded(left, left_id, "__la"), exploded(right, right_id, "__lb")
    pairs = lt.join(rt, ["__t", *block]).groupBy(left_id, right_id, "__la", "__lb").agg(F.count("*").alias("shared"))
    return pairs.select(left_id, right_id, "shared", (F.col("shared") / (F.col("__la") + F.col("__lb") - F.col("shared"))).alias("jaccard"))


def _keys(permutations: int) -> list[tuple[int, int]]:
    return [((7919 * (i + 1) * 104729) % 2097143 + 1, (15485863 * (i + 3)) % PRIME) for i in range(permutations)]


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def signature(tokens: Column, permutations: int = PERMUTATIONS) -> Column:
    """MinHash signature: for each permutation the smallest of (a * h + b) mod a prime over the tokens; null for no tokens.

    An expression, for a few rows; signatures() is many times faster on tables.
    """
    h = _hashes(tokens)
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in _keys(permutations)])
    return F.when(F.size(tokens) > 0, T.let(h, lambda own: F.transform(keys, lambda k: F.array_min(F.transform(own, lambda x: (k["a"] * x.bitwiseAND(F.lit(0x3FFFFFF)) + k["b"] + x) % PRIME)))))


def _minima(off: np.ndarray, h: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
    """(rows, keys): the smallest value of each key over the hashes off[i] .. off[i + 1] of each row, which has some."""
    out = np.empty((len(off) - 1, len(keys)), np.int64)
    low = h & 0x3FFFFFF
    for i, (a, b) in enumerate(keys):
        out[:, i] = np.minimum.reduceat((low * a + (h + b)) % PRIME, off[:-1])
    return out


def signatures(df: DataFrame, columns: list[str], tokens: str = "tokens", bands: bool = False, permutations: int = PERMUTATIONS, hashed: bool = False) -> DataFrame:
    """The columns of df with `signature`, the same as signature() gives, or with `bands` the hashes of its BANDS bands; both null for no tokens.

    Hashes are made by Spark; their minima are numpy's, over a record batch at once. hashed: the tokens are the 64-bit hashes of tokens, as banded() gives them.
    """
    ship(df.sparkSession)
    own = F.transform(tokens, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))) if hashed else _hashes(F.col(tokens))
    rows = df.select(*columns, own.alias("__h"))
    name, keys, many, rows_of = ("bands" if bands else "signature"), _keys(permutations), BANDS if bands else permutations, BAND_ROWS
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(columns)]), f"{name} array<long>"])

    def run(batches):
        for b in batches:
            lists = b.column(len(columns))
            size = lists.value_lengths().fill_null(0).to_numpy()
            some = np.flatnonzero(size > 0)
            got = _minima(np.concatenate([[0], np.cumsum(size[some])]), lists.flatten().to_numpy(), keys)
            if bands:
                x = got[:, : BANDS * rows_of].reshape(len(some), BANDS, rows_of).view(np.uint64)
                h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for k in range(rows_of):
                    h = (h ^ x[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                    h = h ^ (h >> np.uint64(29))
                got = h.view(np.int64)
            off = np.concatenate([[0], np.cumsum(np.where(size > 0, many, 0))]).astype(np.int32)
            value = pa.ListArray.from_arrays(pa.array(off, pa.int32(), mask=np.append(size == 0, False)), pa.array(got.reshape(-1))) if len(some) < len(size) else pa.ListArray.from_arrays(pa.array(off), pa.array(got.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], value], [*b.schema.names[: len(columns)], name])

    return rows.mapInArrow(run, schema)


def digest_signature(tokens: Column, permutations: int = 16) -> Column:
    """The smallest of the first 8 hex digits of sha1(`k:token`) for each k, joined; it needs no hash that only one engine has."""
    return T.let(tokens, lambda own: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda k: F.array_min(F.transform(own, lambda t: F.substring(F.sha1(F.concat(k.cast("string"), F.lit(":"), t).cast("binary")), 1, 8)))), ""))


def estimate(a: Column, b: Column) -> Column:
    """Share of equal registers of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def banded(df: DataFrame, key: str, block: list[str] = (), tokens: str = "tokens") -> DataFrame:
    """(key, hashes, block columns, bands): what lsh_join() reads; signatures are the costly part, so write it out where it is read twice.

    `hashes` are 64-bit hashes of the tokens, which are compared much faster than texts.
    """
    own = df.select(key, F.transform(tokens, lambda t: F.xxhash64(t)).alias("hashes"), F.col(tokens).alias("tokens"), *block)
    return signatures(own, [key, "hashes", *block], bands=True)


def lsh_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: list[str] = (), minimum: float = 0.0) -> DataFrame:
    """(left_id, right_id, jaccard) of pairs of banded() tables that share a band, with the exact Jaccard of their tokens."""
    l, r = (df.select(key, *block, F.explode("bands").alias("__band")) for df, key in ((left, left_id), (right, right_id)))
    pairs = l.join(r, ["__band", *block]).select(left_id, right_id).distinct()
    both = pairs.join(left.select(left_id, "hashes"), left_id).join(right.select(right_id, F.col("hashes").alias("__rt")), right_id)
    return both.select(left_id, right_id, jaccard(F.col("hashes"), F.col("__rt")).alias("jaccard")).where(F.col("jaccard") >= minimum)


def top_k(pairs: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; the limit is pushed below the shuffle by the optimizer."""
    return pairs.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


def lacking(rows: DataFrame, pairs: DataFrame, key: str, minimum: int) -> DataFrame:
    """The rows that have fewer than `minimum` pairs."""
    return rows.join(pairs.groupBy(key).count().where(F.col("count") >= minimum).select(key), key, "left_anti")


def augment(direct: DataFrame, via: DataFrame, row: str, item: str) -> DataFrame:
    """Direct pairs and pairs found by an analogue's text (column via), one for each item: the larger Jaccard, direct first."""
    both = direct.withColumn("via", F.lit(None).cast("string")).unionByName(via)
    rank = F.row_number().over(Window.partitionBy(row, item).orderBy(F.desc("jaccard"), F.col("via").isNotNull(), "via"))
    return both.withColumn("__r", rank).where("__r = 1").drop("__r")
