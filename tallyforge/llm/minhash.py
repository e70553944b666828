"""Near-duplicate documents with HyperMinHash sketches.

Sketch. Each distinct shingle hash goes to one of BANDS * ROWS buckets; a bucket keeps its smallest
hash as a leading-zero count and the MANTISSA bits after the leading one, 16 bits in all. An empty
bucket i copies the filled bucket j with the smallest fixed random number for (i, j), so that two
texts' registers agree with a chance of about their Jaccard similarity however short they are.

Links. Documents with equal shingle sets are one class. Classes that agree in a whole band of
registers share a bucket; each class is first compared with the class it shares most buckets with
among the smallest numbers of its buckets, which joins nearly all groups of copies with one
comparison a class. Then buckets that still hold several components are searched whole for pairs of
different components. Full shingle sets, of 64-bit hashes, decide on each pair whose estimated
similarity, less what equal registers by chance add, is not clearly too low, and only links join
components. Large buckets are split into pairs of blocks, so a group handed to a function has about
2 * BLOCK rows at most, and no pair is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import NON_SPACE, U64, Words, mix, signed, text_buffer
from tallyforge.llm.common import arrow_rows, components, documents, map_blocks, saved, ship, unsaved
from tallyforge.llm.numbering import free

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
BLOCK = 1000
#: Standard deviations by which a linked pair's estimate may be too low; beyond it a pair is not looked at (a chance of 1e-9).
SLACK = 6
_rng = np.random.default_rng(11)
_RANK = _rng.random((REGISTERS, REGISTERS)).astype(np.float32)
_BAND = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and their offsets."""
    w = Words(raw, off, NON_SPACE, lower=True)
    at, h = w.grams(size)
    text = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        h = np.concatenate([h, w.gram_hash(w.first[short], w.counts[short])])
        text = np.concatenate([text, short])
    order = np.argsort(h)
    order = order[np.argsort(text[order].astype(np.uint16 if len(off) < 1 << 16 else np.int64), kind="stable")]
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(off)))


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) 16-bit registers."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    value = mix(h ^ U64(0x243F6A8885A308D3))
    bucket = ((h >> U64(32)) % U64(REGISTERS)).astype(np.int64)
    low = np.full(n * REGISTERS, ~U64(0), U64)
    np.minimum.at(low, text * REGISTERS + bucket, value)
    low = low.reshape(n, REGISTERS)
    filled = low != ~U64(0)
    v = low >> U64(11)
    zeros = (53 - np.frexp(v.astype(float))[1]).astype(U64)
    out = ((zeros << U64(MANTISSA)) | (((v << zeros) >> U64(52 - MANTISSA)) & U64((1 << MANTISSA) - 1))).astype(np.uint16)
    for t in np.flatnonzero(~filled.all(axis=1) & (np.diff(first) > 0)):
        have, lack = np.flatnonzero(filled[t]), np.flatnonzero(~filled[t])
        out[t, lack] = out[t, have[np.argmin(_RANK[np.ix_(lack, have)], axis=1)]]
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands."""
    x = (registers.astype(U64) + U64(1)) * _BAND
    return mix(x.reshape(-1, BANDS, ROWS).sum(axis=2) + np.arange(BANDS, dtype=U64))


def by_chance(nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Chance that registers of different smallest hashes are equal, for sets of nx and ny shingles."""
    k = np.arange(54)[:, None]

    def zeros(n):
        per = np.maximum(1.0, n / REGISTERS)
        return (1 - 2.0 ** -(k + 1)) ** per - np.where(k == 0, 0.0, (1 - 2.0**-k)) ** per

    return (zeros(nx) * zeros(ny)).sum(axis=0) / (1 << MANTISSA)


def set_sums(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two sums over each shingle set that tell sets apart."""
    out = []
    for salt in (0x13198A2E03707344, 0x4A4093822299F31D):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(salt)), dtype=U64)])
        out.append(total[first[1:]] - total[first[:-1]])
    return out


def sketch_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, s1, s2 (a 128-bit sum over the shingle set), sketch."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = shingle_sets(*text_buffer(batch.column(1)))
        sums = [pa.array(signed(x)) for x in set_sums(h, first)]
        regs = sketches(h, first)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), *sums, pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n", "s1", "s2", "sketch"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_blocks(rows, "doc_id long, n long, s1 long, s2 long, sketch binary", each)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, rep): one row for each band of each class."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = bands(_registers(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "rep"])

    ship(classes.sparkSession)
    return classes.select("rep", "sketch").mapInArrow(run, "key long, rep long")


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of sketches, row by row, less what equal registers by chance add."""
    p = by_chance(na.astype(float), nb.astype(float))
    return ((a == b).mean(axis=1) - p) / (1 - p)


def slack(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """How far below the threshold an estimate may fall: SLACK standard deviations of an estimate at the threshold."""
    return SLACK * np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, np.maximum(na, nb)))


def linked(p: np.ndarray, q: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether two sorted shingle sets are similar enough."""
    if len(q) < len(p):
        p, q = q, p
    if denominator * len(p) < numerator * len(q):
        return False
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    common = int((q[at] == p).sum())
    return denominator * common >= numerator * (len(p) + len(q) - common)


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule it out and whose full shingle sets are similar enough."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    threshold = numerator / denominator

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = ([np.frombuffer(x.as_buffer(), U64) for x in batch.column(i)] for i in (2, 3))
            np_, nq = (np.array([len(x) for x in side]) for side in (p, q))
            maybe = estimates(_registers(batch.column(4)), _registers(batch.column(5)), np_, nq) >= threshold - slack(np_, nq, threshold)
            keep = [bool(m) and linked(x, y, numerator, denominator) for m, x, y in zip(maybe, p, q)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "hb", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rep, sketch, hashes): the sorted shingle set of a document of each class in ids(rep, low, n, s1, s2, sketch); more than once if rows are equal."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = shingle_sets(*text_buffer(batch.column(5)))
        own = [h[x:y] for x, y in zip(first[:-1], first[1:])]
        # Rows of one id may have different texts; the class is that of its own sums.
        good = np.stack([np.diff(first) == batch.column(1).to_numpy(), *(signed(x) == batch.column(i).to_numpy() for i, x in zip((2, 3), set_sums(h, first)))]).all(axis=0)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array([x.tobytes() for x in own], pa.binary())], ["rep", "sketch", "hashes"]).filter(pa.array(good))

    rows = docs.select(F.col(doc_id).cast("long").alias("low"), F.col(text).alias("text")).join(ids, "low").select("rep", "n", "s1", "s2", "sketch", "text")
    return map_blocks(rows, "rep long, sketch binary, hashes binary", each)


def close_pairs(shared: DataFrame, sets: DataFrame, label: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links that join components within a bucket, as many as it takes to join them.

    Of a bucket with several components, the rows outside its largest one are compared with all rows,
    block by block; one large group of copies with a few strangers in its bucket costs a row each. A
    pair's full sets are compared if its estimate is not clearly below the threshold and its two
    components are not joined yet; only links join components.
    """
    rows = shared.join(label, "rep")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top")).where("n > top.c")
    mixed = mixed.select("key", F.col("top.component").alias("most"), F.ceil(F.col("n") / BLOCK).alias("pa"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).alias("po"))
    rows = rows.join(mixed, "key").select("key", "rep", "component", (F.col("component") != F.col("most")).alias("other"), F.pmod(F.xxhash64("rep"), "pa").alias("a"), F.pmod(F.xxhash64("rep", F.lit(1)), "po").alias("o"), "pa", "po")
    left = rows.select("key", "rep", "component", "other", F.lit(0).alias("side"), F.col("a").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("po") - 1)).alias("j"))
    right = rows.where("other").select("key", "rep", "component", "other", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pa") - 1)).alias("i"), F.col("o").alias("j"))
    rows = left.unionByName(right).join(sets, "rep")
    threshold = numerator / denominator

    def search(table: pa.Table) -> pa.Table:
        rep, comp = (table.column(c).to_numpy() for c in ("rep", "component"))
        other, side = table.column("other").to_numpy().astype(bool), table.column("side").to_numpy()
        regs = _registers(table.column("sketch").combine_chunks())
        sets_of = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        n = np.array([len(x) for x in sets_of])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        for x in left:
            # Two rows that are both outside the largest component meet in either order; one counts.
            ys = right[(comp[right] != comp[x]) & ((rep[right] > rep[x]) | ~other[x])]
            small, large = np.minimum(n[ys], n[x]), np.maximum(n[ys], n[x])
            ys = ys[denominator * small >= numerator * large]
            if not len(ys):
                continue
            estimate = estimates(regs[ys], regs[x][None, :], n[ys], n[[x]])
            ok = estimate >= threshold - slack(n[ys], n[[x]], threshold)
            found.append((np.stack([np.full(ok.sum(), x), ys[ok]]), estimate[ok]))
        out: list[tuple[int, int]] = []
        if found:
            pairs = np.concatenate([f[0] for f in found], axis=1)
            pairs = pairs[:, np.argsort(-np.concatenate([f[1] for f in found]), kind="stable")]
            top = {int(c): int(c) for c in np.unique(comp)}

            def root(c: int) -> int:
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            for x, y in pairs.T:
                u, v = root(int(comp[x])), root(int(comp[y]))
                if u != v and linked(sets_of[x], sets_of[y], numerator, denominator):
                    top[max(u, v)] = min(u, v)
                    out.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if denominator * |A & B| >= numerator * |A | B| for their sets of five-word
    shingles. A null text or one without words is linked with nothing, and so is a row with a null
    id. Rows of one id are documents of their own, each with its text. Ids are integers or cast to
    them. Only the two named columns are read. No rows give no rows.
    """
    ship(docs.sparkSession)
    table = saved(sketch_table(docs, doc_id, text))
    some = table.where("n > 0 AND doc_id IS NOT NULL")
    # Classes get numbers of their own, as two texts may have one id; writing them fixes the numbers.
    classes = some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("low"), F.first("sketch").alias("sketch"))
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()))
    buckets = bucket_rows(classes)
    repeated = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).where("size > 1")
    shared = saved(buckets.join(repeated.select("key", "lead"), "key"))
    best = shared.where("rep <> lead").groupBy("rep", "lead").count().groupBy("rep").agg(F.max(F.struct("count", -F.col("lead"))).alias("x"))
    stars = saved(best.select(F.expr("-x.col2").alias("a"), F.col("rep").alias("b")))
    sets = saved(full_sets(docs, classes.join(shared.select("rep").distinct(), "rep"), doc_id, text).dropDuplicates(["rep"]))
    with arrow_rows(docs.sparkSession, 500):
        links = saved(confirm(stars, sets, numerator, denominator))
    first = components(links)
    label = classes.select("rep").join(first.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    more = saved(close_pairs(shared.select("key", "rep"), sets, label, numerator, denominator))
    final = components(first.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))
    unsaved(shared, stars, sets, links, more)
    label = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", "low", F.coalesce("component", "rep").alias("component"))
    smallest = label.groupBy("component").agg(F.min("low").alias("component_id"))
    label = label.join(smallest, "component").select("n", "s1", "s2", "component_id")
    joined = table.select("doc_id", "n", "s1", "s2").join(label, ["n", "s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group exactly one row, the one with the smallest id.

    Rows are told apart by a number that is written out with them, so rows of one id are compared with
    each other and rows with a null id like others; a null id counts as larger than any other.
    """
    row = free("row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(rows.select(row, F.col(text).alias("text")), row, "text").select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), row))
    chosen = rows.select(row, doc_id).join(groups, row).groupBy("component_id").agg(first.alias("x")).select(F.col(f"x.{row}").alias(row))
    return rows.join(chosen, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
  FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS top FROM documents
      UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.id WHERE r.top < e.b),
k AS (SELECT id, min(top) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, k.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN k ON k.id = d.doc_id
"""
