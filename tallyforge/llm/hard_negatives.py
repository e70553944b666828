"""Hard negatives by distributed radix selection.

A window asks for the first k rows of an anchor: those of its label (its positives), or those of other
labels whose scores lie between two bounds (hard negatives of one positive). Which rows these are is found
without gathering candidates: tasks count scores by their highest digit, the counts of all tasks are
summed, and the digit at which k rows are reached is fixed; then the next digit is counted among the rows
that share the digits so far, until a threshold holds exactly k rows. Digits of the score come first and,
where rows tie at the threshold, digits of vec_id. One more pass gathers the rows within the thresholds, k
for each window.

Anchors are taken in blocks of bounded size that are sent to all tasks; rows are never moved. Scores are
whole numbers: vectors are scaled, rounded down and multiplied in exact arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import saved, ship

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Bounds on a negative's score, in hundredths of its positive's.
LEAST, MOST = 50, 95
#: Anchors in a block, bytes of a block's vectors, bits of a digit, and cells (windows x rows) that a task compares at once.
BLOCK, BLOCK_BYTES, DIGIT, CELLS = 512, 8 << 20, 8, 1 << 20

ROWS = "vec_id long, label long, v binary"


@dataclass
class Windows:
    """What to select for each window, and how far it is known. Parallel arrays over windows."""

    anchor: np.ndarray  # place in the block
    same: np.ndarray  # rows of the anchor's label, or of other labels
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray  # rows still to be found among those at the digits so far; 0: done
    score: np.ndarray  # the distance high - score of the last row found so far, as far as its digits are fixed
    id: np.ndarray  # the same of vec_id less the smallest one
    open: np.ndarray

    def __len__(self) -> int:
        return len(self.anchor)

    def take(self, at) -> Windows:
        return Windows(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # (anchors, width) whole numbers


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(embedding, bad), F.lit(False))


def _packed(df: DataFrame) -> DataFrame:
    """ROWS of (vec_id, label, q): the components as bytes of 64-bit numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q")
            off = q.offsets.to_numpy().astype(np.int64) * 8
            raw = np.ascontiguousarray(q.values.to_numpy(zero_copy_only=False), np.int64).tobytes()
            v = pa.array([raw[s:e] for s, e in zip(off[:-1], off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), v], ["vec_id", "label", "v"])

    return df.mapInArrow(pack, ROWS)


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of packed vectors; shorter ones end in zeros, which add nothing to a score."""
    out = np.zeros((len(v), width), np.int64)
    for i, x in enumerate(v):
        own = np.frombuffer(x.as_buffer(), np.int64)
        out[i, : len(own)] = own
    return out


def _scores(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors, rows): in doubles where all sums stay below 2 ** 53, else in 64 bits."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(a.shape[1], 1)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return a @ rows.T


def _over_rows(rows: DataFrame, anchors: Anchors, windows: Windows, first_id: int, schema: str, start: Callable, each: Callable, end: Callable) -> DataFrame:
    """Map over all rows: each(state, windows, distance, id, mask, vec_ids) for blocks of rows; end(state) gives the batches."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, w = sent.value
        state = start(w)
        step = max(1, CELLS // max(len(w), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
                s = _scores(anchors.vectors, _matrix(b.column("v"), anchors.vectors.shape[1]))[w.anchor]
                alike = (anchors.labels[w.anchor][:, None] == labels[None, :]) == w.same[:, None]
                mask = alike & (anchors.ids[w.anchor][:, None] != ids[None, :]) & (s >= w.low[:, None]) & (s <= w.high[:, None])
                yield from each(state, w, w.high[:, None] - s, np.broadcast_to(ids - first_id, s.shape), mask, ids)
        yield from end(state)

    return rows.mapInArrow(run, schema)


def _counted(rows: DataFrame, anchors: Anchors, w: Windows, first_id: int, part: str, shift: int) -> dict[int, list[tuple[int, int]]]:
    """{window: [(digit, rows), ...]} with digits ascending, of the rows that share each open window's digits so far."""
    schema = "w int, digit int, n long"

    def each(state, w, distance, own, mask, ids):
        if part == "score":
            value, fixed = distance, w.score[:, None]
        else:
            mask = mask & (distance == w.score[:, None])
            value, fixed = own, w.id[:, None]
        mask = mask & (value >> (shift + DIGIT) == fixed >> (shift + DIGIT))
        at, row = np.nonzero(mask)
        digit = (value[at, row] >> shift) & ((1 << DIGIT) - 1)
        np.add.at(state, (at, digit), 1)
        return ()

    def end(state):
        at, digit = np.nonzero(state)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(state[at, digit])], ["w", "digit", "n"])

    per_task = _over_rows(rows, anchors, w, first_id, schema, lambda w: np.zeros((len(w), 1 << DIGIT), np.int64), each, end)
    summed = per_task.groupBy("w", "digit").agg(F.sum("n").alias("n"))
    # Only the digit at which a window is full leaves the executors: one row for each window of the block.
    before = F.sum("n").over(Window.partitionBy("w").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
    need = rows.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(w.need)], "w int, need long")
    full = summed.withColumn("before", F.coalesce(before, F.lit(0))).join(need, "w").where("before < need").groupBy("w").agg(F.max(F.struct("digit", "before", "n")).alias("last"))
    return {r["w"]: r["last"] for r in full.collect()}


def _digits(bits: int) -> int:
    return max(1, -(-bits // DIGIT))


def _settled(rows: DataFrame, anchors: Anchors, w: Windows, first_id: int, id_bits: int) -> Windows:
    """The windows with their thresholds: exactly their first k rows, or all if fewer, are at or before (score, id)."""
    digits = {"score": _digits(int((w.high - w.low).max(initial=0)).bit_length()), "id": _digits(id_bits)}
    for part, n in digits.items():
        getattr(w, part)[:] = (1 << n * DIGIT) - 1  # not known yet: every row is within it
    for part, n in digits.items():
        for shift in range((n - 1) * DIGIT, -1, -DIGIT):
            at = np.flatnonzero(w.open)
            if not len(at):
                return w
            found = _counted(rows, anchors, w.take(at), first_id, part, shift)
            for j, i in enumerate(at):
                own = found.get(j)
                value = getattr(w, part)
                if own is None:  # no rows at all, which only the first digit can find
                    w.open[i] = False
                    continue
                low = (1 << shift) - 1
                value[i] = value[i] & ~((1 << (shift + DIGIT)) - 1) | own["digit"] << shift | low
                # Of the rows at this digit all are wanted, so no further one matters; fewer than wanted were there at all.
                if own["before"] + own["n"] <= w.need[i]:
                    w.open[i] = False
                else:
                    w.need[i] -= own["before"]
    return w


def _gathered(rows: DataFrame, anchors: Anchors, w: Windows, first_id: int) -> DataFrame:
    """(w, vec_id, score) of the rows within the thresholds."""
    names = ["w", "vec_id", "score"]

    def each(state, w, distance, own, mask, ids):
        score = w.score[:, None]
        at, row = np.nonzero(mask & ((distance < score) | (distance == score) & (own <= w.id[:, None])))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids[row]), pa.array(w.high[at] - distance[at, row])], names)

    return _over_rows(rows, anchors, w, first_id, "w int, vec_id long, score long", lambda w: None, each, lambda state: ())


def _windows(anchor: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> Windows:
    n = len(anchor)
    return Windows(anchor, np.full(n, same), low, high, np.full(n, k, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), high >= low)


def select(rows: DataFrame, anchors: Anchors, w: Windows, first_id: int, id_bits: int) -> DataFrame:
    """(w, vec_id, score) of the first rows of each window: the highest scores, ties by the smaller vec_id."""
    settled = _settled(rows, anchors, replace(w), first_id, id_bits)
    return _gathered(rows, anchors, settled, first_id)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", embedding: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor the first `positives` other rows of its label, and for each of these the first
    `negatives` rows of other labels with least * positive_score <= 100 * negative_score <= most *
    positive_score. Higher scores come first, ties by the smaller vec_id.

    Rows without an id or label, with a null vector or a component that is null or not finite take no
    part. Rows with the anchor's id are not other rows. A repeated row counts as often as it is there, as
    an anchor too. Of vectors of unequal lengths the shorter counts as ending in zeros. Scores that
    do not fit 64 bits are an error. Empty tables, or tables without anchors, give no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.col(embedding).alias("e"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("e"))).select("vec_id", "label", "is_anchor", quantised(F.col("e"), scale).alias("q"))
    largest = F.array_max(F.transform("q", lambda x: F.abs(x)))
    size = own.agg(F.max(F.size("q")).alias("width"), F.max(largest).alias("largest"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if size["width"] is None:
        return spark.createDataFrame([], schema)
    width, bound = max(size["width"], 1), (size["largest"] or 0) ** 2 * max(size["width"], 1)
    if bound >= 1 << 61:
        raise ValueError("scores do not fit 64 bits")
    first_id, id_bits = size["first"], max(int(size["last"] - size["first"]).bit_length(), 1)
    rows = saved(_packed(own.select("vec_id", "label", "q")))
    block = max(1, min(block, BLOCK_BYTES // (8 * width)))
    asked = saved(_packed(own.where("is_anchor").select("vec_id", "label", "q")))
    out = None
    for anchors in _blocks(asked, block, width):
        part = saved(_mined(rows, anchors, bound, first_id, id_bits, positives, negatives, least, most))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _blocks(asked: DataFrame, block: int, width: int) -> Iterator[Anchors]:
    """The anchors, a block at a time on the driver."""
    held = []

    def made() -> Anchors:
        return Anchors(np.array([r["vec_id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64), _matrix(pa.array([bytes(r["v"]) for r in held], pa.binary()), width))

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield made()
            held.clear()
    if held:
        yield made()


def _mined(rows: DataFrame, anchors: Anchors, bound: int, first_id: int, id_bits: int, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    spark = rows.sparkSession
    m = len(anchors.ids)
    every = np.arange(m)
    w = _windows(every, True, np.full(m, -bound, np.int64), np.full(m, bound, np.int64), positives)
    # A block's positives: at most `positives` for each of its anchors.
    pairs = sorted((r["w"], -r["score"], r["vec_id"]) for r in select(rows, anchors, w, first_id, id_bits).collect())
    at, scores, ids = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
    scores = -scores
    low, high = -(-least * scores // 100), most * scores // 100
    n = _windows(at, False, low, high, negatives)
    found = select(rows, anchors, n, first_id, id_bits)
    of = spark.createDataFrame([(i, int(anchors.ids[a]), int(p), int(s)) for i, (a, p, s) in enumerate(zip(at, ids, scores))], "w int, anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).join(of, "w").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 3 hard negatives for each of up to 5 positives of every row whose vec_id is divisible by 50; labels of ids divisible by 7 move on by one."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(t, F.col("vec_id") % 50 == 0, label)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, r.label = a.label AS same, list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
