"""A reproducible shuffle: a Feistel permutation with cycle walking over global row numbers.

The rows of a table are numbered 0 .. n - 1 in an order of their values, and the permutation moves row
number i to position p(i). Shard p mod k and slot p div k follow by arithmetic, and p can be undone, so
both directions are computed without any table. Shards differ by one row at most.

The permutation works on pairs (l, r) with l below a and r below b, a the square root of n and b = n / a,
both rounded up. ROUNDS times the halves change places and a keyed hash of one is added to the other modulo
its size. Numbers that leave 0 .. n - 1 (fewer than a of the a * b) are permuted again until they are back.
All of it is whole-number arithmetic in Spark expressions.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import documents, saved, unsaved
from tallyforge.llm.numbering import numbered

ROUNDS = 8
MASK = (1 << 31) - 1
SHARDS = 8


@dataclass(frozen=True)
class Permutation:
    """Of 0 .. rows - 1, below 2 ** 61; `walks` is the largest number of steps that a row needs to come back into range."""

    rows: int
    seed: str = "0"
    walks: int = 1

    @property
    def halves(self) -> tuple[int, int]:
        a = max(math.isqrt(max(self.rows - 1, 0)) + 1, 1)
        return a, max(-(-self.rows // a), 1)

    def keys(self) -> list[tuple[int, int, int, int]]:
        """(k, m1, m2, modulus) of each round; the multipliers are odd."""
        a, b = self.halves
        out = []
        for i in range(ROUNDS):
            d = hashlib.sha256(f"{self.seed}/{i}".encode()).digest()
            k, m1, m2 = (int.from_bytes(d[j : j + 4], "big") & MASK for j in (0, 4, 8))
            out.append((k, m1 | 1, m2 | 1, b if i % 2 else a))
        return out

    def _rounds(self) -> list[Column]:
        return [F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("k", "m1", "m2", "size"), key)]) for key in self.keys()]

    def _forth(self, x: Column) -> Column:
        b = F.lit(self.halves[1])
        start = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(
            F.array(*self._rounds()), start,
            lambda at, k: F.struct(at["r"].alias("l"), ((at["l"] + _mixed(at["r"], k)) % k["size"]).alias("r")),
            lambda at: at["l"] * b + at["r"],
        )

    def _back(self, x: Column) -> Column:
        b = F.lit(self.halves[1])
        start = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(
            F.array(*self._rounds()[::-1]), start,
            lambda at, k: F.struct(F.pmod(at["r"] - _mixed(at["l"], k), k["size"]).alias("l"), at["l"].alias("r")),
            lambda at: at["l"] * b + at["r"],
        )

    def _walked(self, x: Column, step) -> Column:
        once = step(x)
        if self.walks < 2:
            return once
        return F.aggregate(F.sequence(F.lit(2), F.lit(self.walks)), once, lambda at, _: F.when(at < self.rows, at).otherwise(step(at)))

    def position(self, row: Column) -> Column:
        """Where a row number goes."""
        return self._walked(row.cast("long"), self._forth)

    def row(self, position: Column) -> Column:
        """Which row number is at a position."""
        return self._walked(position.cast("long"), self._back)


def _div(x: Column, by: Column) -> Column:
    return F.call_function("div", x, by)


def _mixed(x: Column, k: Column) -> Column:
    """A hash of 31 bits of x, below 2 ** 31; products stay below 2 ** 62."""
    once = _folded(x.bitwiseXOR(k["k"]) * k["m1"])
    return _folded(once * k["m2"])


def _folded(x: Column) -> Column:
    return F.shiftright(x, 29).bitwiseAND(F.lit(MASK)).bitwiseXOR(F.shiftright(x, 13).bitwiseAND(F.lit(MASK)))


def permutation(spark: SparkSession, rows: int, seed: str = "0") -> Permutation:
    """The permutation of so many rows, with as many walks as its rows need.

    A row that leaves the range does so to a number outside of it that the permutation reaches from inside;
    these numbers (fewer than the square root of rows) are walked until all are back. They do come back, as
    each is on a cycle with a row; cycles that lie outside as a whole are met by no row.
    """
    p = Permutation(rows, seed)
    a, b = p.halves
    if a * b == rows:
        return p
    left = spark.range(rows, a * b).where(p._back(F.col("id")) < rows)
    walks = 1
    while left.where(Permutation(rows, seed, walks)._walked(F.col("id"), p._forth) >= rows).limit(1).count():
        walks *= 2
    return Permutation(rows, seed, walks + 1)


def assign(df: DataFrame, order: list[Column], shards: int = SHARDS, seed: str = "0", names: tuple[str, str, str] = ("row_number", "shard", "slot")) -> DataFrame:
    """df's rows with their number in the given order (long), shard (int) and slot (long) under the three names.

    Each row gets a place of its own: nulls order first, rows that are equal in `order` get places in no
    defined order, repeated rows one place each, and an empty table gives no rows. The same rows give the
    same places whatever their partitions. Name no column of df in `names`; others are carried along.
    """
    number, shard, slot = names
    if clash := set(names) & set(df.columns):
        raise ValueError(f"taken column names: {sorted(clash)}")
    rows = numbered(df, order, number)
    p = permutation(df.sparkSession, rows.count(), seed)
    k = F.lit(shards)
    position = "__position"
    while position in rows.columns:
        position += "_"
    return rows.withColumn(position, p.position(F.col(number))).select(*rows.columns, (F.col(position) % k).cast("int").alias(shard), _div(F.col(position), k).alias(slot))


def write_shards(assigned: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Parquet folders shard=0, shard=1, ...; files hold ranges of slots in their order."""
    assigned.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op11_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`.

    Rows are numbered by doc_id, size and checksum of the text; rows equal in these give equal results. A null
    text has no bytes, hence size 1 and checksum 0, as an empty one. Equal texts are rows like others.
    """
    body = F.coalesce("text", F.lit(""))
    sized = documents(spark, sf_dir).select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    small = saved(sized)  # texts are read once, not once more for the sort's ranges
    placed = assign(small, [F.asc_nulls_first("doc_id"), F.col("size"), F.col("text_crc32")], names=("row_number", "shard", "slot"))
    unsaved(small)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_steps() -> list[int]:
    """What four bits of the checksum's remainder turn into."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """DuckDB's unsigned crc32 of the UTF-8 bytes of a text that is not null, four bits at a time."""
    bits = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: (instr('0123456789ABCDEF', c) - 1)::BIGINT)"
    step = f"lambda c, x: xor(c >> 4, ({_crc_steps()}::BIGINT[])[(xor(c, x) & 15) + 1])"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT) END"


def _op11_sql() -> str:
    keys = [k[:3] for k in Permutation(1).keys()]
    fold = lambda x: f"xor(({x} >> 29) & {MASK}, ({x} >> 13) & {MASK})"
    x = "list_transform([{0}], lambda v: {1})[1]"
    rounds, side = "", "w0"
    for i, (k, m1, m2) in enumerate(keys):
        once = x.format(f"xor(r, {k}) * {m1}", fold("v"))
        hashed = x.format(f"{once} * {m2}", fold("v"))
        rounds += f"w{i + 1} AS (SELECT row, step, r AS l, (l + {hashed}) % {'b' if i % 2 else 'a'} AS r, n, a, b FROM {side}),\n"
        side = f"w{i + 1}"
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, {crc32_sql("coalesce(text, '')")}::BIGINT AS text_crc32 FROM documents),
i AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row FROM s),
m AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM i),
d AS (SELECT n, a, (n + a - 1) // a AS b FROM m),
walk AS (
  SELECT row, 0 AS step, row AS place, n, a, b FROM i, d
  UNION ALL (WITH w0 AS (SELECT row, step, place // b AS l, place % b AS r, n, a, b FROM walk WHERE step = 0 OR place >= n),
  {rounds.rstrip().rstrip(",")}
  SELECT row, step + 1, l * b + r, n, a, b FROM w{len(keys)})),
p AS (SELECT row, place FROM walk WHERE step > 0 AND place < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {SHARDS})::INT AS shard, place // {SHARDS} AS slot, NULL::INT AS grown_shard FROM i JOIN p USING (row)
"""


OP11_SQL = _op11_sql()
