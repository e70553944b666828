"""Near-duplicate vectors with NN-descent.

Equal vectors are one class, and the graph is over classes. Neighbour lists of LIST entries begin
with the best partners in a few random-hyperplane buckets; then each vector's neighbours and reverse
neighbours meet in pairs (neighbours of neighbours), and a pair enters the lists it improves, until
few entries change. Only pairs with a new entry meet.

A list whose entries all reach the threshold is saturated: it may hide more links. Such lists are
enlarged to all of their component: components of the threshold edges are searched whole, in pairs
of blocks of at most BLOCK vectors, and what is kept is each vector's number of links, not the pairs.
A component that is larger than a list is treated the same. Links between components that saturated
lists had no room for are searched exactly: saturated vectors are gathered in balls around one of
their neighbours, and two balls of different components whose centres and radii allow a link are
compared vector by vector. After each descent an audit compares the links of AUDIT vectors with a
search of all rows and logs the recall, and the descent goes on with lists twice as long while it, of
links or per vector, is below RECALL. Where none of these vectors has a link, it asks those with the most similar
neighbours, and where they have none either, nothing can be measured and the search is exact. At
LONGEST_LIST the balls take all vectors, which finds every link.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import components, saved, ship, unsaved

THRESHOLD = 0.95
LIST = 10
TABLES = 4
BUCKET = 64
ROUNDS = 8
SETTLED = 0.002
BLOCK = 1000
AUDIT = 2000
RECALL = 0.98
LONGEST_LIST = 160
log = logging.getLogger(__name__)


def unit(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of unit length in double precision, from the bytes of vectors of one dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    x = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable_bytes(column: pa.Array, kind: str) -> pa.Array:
    """The bytes of each vector; null for one that is null, empty or zero, or has a null or non-finite component."""
    size = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    values = column.flatten()
    x = pc.fill_null(values.cast(pa.float32() if kind == "<f4" else pa.float64()), float("nan")).to_numpy(zero_copy_only=False).astype(kind)
    first = np.concatenate([[0], np.cumsum(size)])
    sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[first])
    good = (size > 0) & (sums(~np.isfinite(x)) == 0) & (sums(x != 0) > 0)
    data = x[np.repeat(good, size)]
    off = np.concatenate([[0], np.cumsum(np.where(good, size, 0))]) * np.dtype(kind).itemsize
    mask = pa.py_buffer(np.packbits(good, bitorder="little"))
    return pa.Array.from_buffers(pa.large_binary(), len(good), [mask, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def classes_of(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, vec): the bytes of each usable vector, null for others."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), usable_bytes(b.column(1), kind)], ["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary")


def first_lists(vectors: DataFrame, kind: str, length: int, n: int, seed: int) -> DataFrame:
    """(u, v, s): each vector's best partners in its buckets of TABLES sets of random hyperplanes."""
    planes = max(0, int(np.ceil(np.log2(max(1, n / BUCKET)))))

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dims = np.asarray(b.column(1))
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = unit(part.column(2), kind)
                for t in range(TABLES):
                    h = np.random.default_rng([seed, t, int(d)]).normal(size=(x.shape[1], planes))
                    bits = ((x @ h > 0) << np.arange(planes)).sum(axis=1) if planes else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(bits.astype(np.int64)), part.column(0), part.column(1), part.column(2)], ["t", "code", "u", "dim", "vec"])

    coded = vectors.select(F.col("rep").alias("u"), "dim", "vec").mapInArrow(code, "t int, code long, u long, dim int, vec binary")
    sizes = coded.groupBy("t", "dim", "code").agg(F.ceil(F.count("*") / (4 * BUCKET)).alias("parts"))
    rows = coded.join(sizes, ["t", "dim", "code"]).withColumn("part", F.pmod(F.xxhash64("u", "t"), F.col("parts")))

    def best(table: pa.Table) -> pa.Table:
        u, x = table.column("u").to_numpy(), unit(table.column("vec"), kind)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        k = min(length, len(u) - 1)
        if k < 1:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pa.table({"u": np.repeat(u, k), "v": u[at].reshape(-1), "s": np.take_along_axis(s, at, 1).reshape(-1)})

    return rows.groupBy("t", "dim", "code", "part").applyInArrow(best, "u long, v long, s double")


def shortened(entries: DataFrame, length: int) -> DataFrame:
    """The best `length` entries (u, v, s, fresh) of each list; an entry is fresh if no older one equals it."""
    once = entries.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= length).drop("r")


def meet(graph: DataFrame, vectors: DataFrame, kind: str, length: int, n: int) -> DataFrame:
    """(u, v, s): pairs of neighbours of one vector that improve a list."""
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "s", "fresh")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("s"), "x"))
    back = back.withColumn("r", rank).where(F.col("r") <= length).select("w", "x", "fresh")
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), "fresh").unionByName(back).groupBy("w", "x").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("u").agg(F.count("*").alias("c"), F.min("s").alias("low")).select(F.col("u").alias("x"), F.when(F.col("c") < length, F.lit(-2.0)).otherwise(F.col("low")).alias("low"))
    sent = vectors.select(F.col("rep").alias("x"), "dim", "vec").join(worst, "x", "left").select("x", "dim", "vec", F.coalesce("low", F.lit(-2.0)).alias("low"))
    groups = max(1, n // 100)
    rows = around.join(sent, "x").withColumn("g", F.pmod(F.xxhash64("w"), F.lit(groups)))

    def pairs(table: pa.Table) -> pa.Table:
        w, x, fresh, low = (table.column(c).to_numpy() for c in ("w", "x", "fresh", "low"))
        vec = unit(table.column("vec"), kind)
        order = np.argsort(w, kind="stable")
        w, x, fresh, low, vec = w[order], x[order], fresh[order].astype(bool), low[order], vec[order]
        cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
        out = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if not fresh[a:b].any():
                continue
            s = vec[a:b] @ vec[a:b].T
            good = (fresh[a:b, None] | fresh[None, a:b]) & (s > low[a:b, None])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            out[0].append(x[a + i]), out[1].append(x[a + j]), out[2].append(s[i, j])
        none = np.zeros(0, np.int64)
        return pa.table({"u": np.concatenate([none, *out[0]]), "v": np.concatenate([none, *out[1]]), "s": np.concatenate([np.zeros(0), *out[2]])})

    return rows.groupBy("g", "dim").applyInArrow(pairs, "u long, v long, s double")


def descend(vectors: DataFrame, graph: DataFrame, kind: str, length: int, n: int, rounds: int) -> DataFrame:
    for _ in range(rounds):
        found = meet(graph, vectors, kind, length, n).withColumn("fresh", F.lit(1))
        after = saved(shortened(graph.withColumn("fresh", F.lit(0)).unionByName(found), length))
        changed = after.agg(F.sum("fresh")).first()[0] or 0
        unsaved(graph)
        graph = after
        if changed <= SETTLED * n * length:
            break
    return graph


def count_links(members: DataFrame, kind: str, threshold: float, n: int) -> DataFrame:
    """(rep, links): links of each vector to other vectors of its component, counting copies; members(component, rep, size, vec)."""
    parts = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = members.join(parts, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Small components share a task's call: one group holds several of them.
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("g", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(max(1, n // BLOCK)))).otherwise(F.col("component")))

    def count(table: pa.Table) -> pa.Table:
        comp, rep, size, own, i, j = (table.column(c).to_numpy() for c in ("component", "rep", "size", "own", "i", "j"))
        vec = unit(table.column("vec"), kind)
        out_rep, out_n = [], []
        for c in np.unique(comp):
            at = np.flatnonzero(comp == c)
            left, right = at[own[at] == i[at[0]]], at[own[at] == j[at[0]]]
            hit = vec[left] @ vec[right].T >= threshold
            hit &= rep[left][:, None] != rep[right][None, :]
            out_rep.append(rep[left]), out_n.append(hit @ size[right])
            if i[at[0]] != j[at[0]]:
                out_rep.append(rep[right]), out_n.append(hit.T @ size[left])
        return pa.table({"rep": np.concatenate(out_rep), "links": np.concatenate(out_n).astype(np.int64)})

    counted = rows.select("g", "i", "j", "dim", "component", "rep", "size", "own", "vec").groupBy("g", "i", "j", "dim").applyInArrow(count, "rep long, links long")
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))


def cross_links(vectors: DataFrame, graph: DataFrame, label: DataFrame, kind: str, threshold: float, length: int, every: bool) -> DataFrame:
    """(a, b): links that join all components between which saturated vectors have links; with `every`, between which any have.

    A ball's centre is the smallest id among a vector and its linked neighbours; balls of more than
    about BLOCK vectors are split.
    """
    lists = graph.where(F.col("s") >= threshold).groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("c"), F.min(F.struct("v", "s")).alias("x"))
    near = F.col("x.v") < F.col("rep")
    own = vectors.join(lists, "rep", "left" if every else "inner").where("true" if every else f"c >= {length}").join(label, "rep", "left")
    own = own.select("rep", "dim", "vec", F.coalesce("component", "rep").alias("component"), F.when(near, F.col("x.v")).otherwise(F.col("rep")).alias("lead"), F.when(near, F.col("x.s")).otherwise(1.0).alias("s"))
    parts = own.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    own = saved(own.join(parts, "lead").withColumn("chunk", F.pmod(F.xxhash64("rep"), "parts")).drop("parts"))
    balls = own.groupBy("lead", "chunk", "dim", "component").agg(F.min("s").alias("low")).join(vectors.select(F.col("rep").alias("lead"), "vec"), "lead")
    blocks = max(1, -(-own.select("lead", "chunk").distinct().count() // BLOCK))
    rows = balls.withColumn("own", F.pmod(F.xxhash64("lead", "chunk"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def allowed(table: pa.Table) -> pa.Table:
        lead, chunk, comp, low, at, i, j = (table.column(c).to_numpy() for c in ("lead", "chunk", "component", "low", "own", "i", "j"))
        vec, radius = unit(table.column("vec"), kind), np.arccos(np.clip(low, -1, 1))
        left, right = np.flatnonzero(at == i[0]), np.flatnonzero(at == j[0])
        s = vec[left] @ vec[right].T
        ok = np.arccos(np.clip(s, -1, 1)) <= np.arccos(threshold) + radius[left][:, None] + radius[right][None, :] + 1e-6
        ok &= comp[left][:, None] != comp[right][None, :]
        if i[0] == j[0]:
            ok = np.triu(ok)
        p, q = np.nonzero(ok)
        hit = s[p, q] >= threshold
        p, q = left[p], right[q]
        return pa.table({"la": lead[p], "ca": chunk[p], "a": comp[p], "lb": lead[q], "cb": chunk[q], "b": comp[q], "hit": pa.array(hit)})

    shape = "la long, ca long, a long, lb long, cb long, b long, hit boolean"
    pairs = saved(rows.select("i", "j", "own", "dim", "lead", "chunk", "component", "low", "vec").groupBy("i", "j", "dim").applyInArrow(allowed, shape))
    # Centres are vectors too: what they join needs no search of its members.
    joined = components(pairs.where("hit").select("a", "b").distinct())
    of = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"t{c}"))
    apart = pairs.where("NOT hit").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ta", "a") != F.coalesce("tb", "b"))
    apart = saved(apart.select("la", "ca", "lb", "cb").withColumn("pair", F.monotonically_increasing_id()))
    groups = max(1, apart.count() // 50)
    side = lambda x, n: apart.select("pair", F.col(f"l{x}").alias("lead"), F.col(f"c{x}").alias("chunk"), F.lit(n).alias("side"))
    members = side("a", 0).unionByName(side("b", 1)).join(own.select("lead", "chunk", "rep", "dim", "vec"), ["lead", "chunk"])

    def meets(table: pa.Table) -> pa.Table:
        pair, right, rep = (table.column(c).to_numpy() for c in ("pair", "side", "rep"))
        vec, out = unit(table.column("vec"), kind), []
        order = np.lexsort((right, pair))
        cuts = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1], [True]]))
        for x, y in zip(cuts[:-1], cuts[1:]):
            at = order[x:y]
            p, q = at[right[at] == 0], at[right[at] == 1]
            s = vec[p] @ vec[q].T
            k, l = np.unravel_index(np.argmax(s), s.shape)
            if s[k, l] >= threshold:
                out.append((rep[p[k]], rep[q[l]]))
        return pa.table({"a": pa.array([int(a) for a, _ in out], pa.int64()), "b": pa.array([int(b) for _, b in out], pa.int64())})

    found = members.withColumn("g", F.pmod(F.xxhash64("pair"), F.lit(groups))).select("g", "dim", "pair", "side", "rep", "vec").groupBy("g", "dim").applyInArrow(meets, "a long, b long")
    links = saved(pairs.where("hit").select(F.col("la").alias("a"), F.col("lb").alias("b")).unionByName(found).distinct())
    unsaved(own, pairs, apart)
    return links


def sampled(vectors: DataFrame, n: int, queries: int = AUDIT) -> DataFrame:
    """About `queries` of the n vectors, by a hash."""
    scale = 1 << 30
    return vectors.where(F.pmod(F.xxhash64("rep", F.lit("audit")), F.lit(scale)) < min(scale, scale * queries // max(1, n)))


def audit(chosen: DataFrame, vectors: DataFrame, counted: DataFrame, kind: str, threshold: float) -> float:
    """Share of the links of the chosen vectors, found by a search of all rows, that the graph has; or the mean share per vector, if that is less.

    NaN if none of them has a link: then nothing was measured.
    """
    asked: dict[int, list] = {}
    for r in chosen.select("rep", "dim", "vec").toLocalIterator():
        asked.setdefault(r["dim"], []).append((r["rep"], bytes(r["vec"])))
    if not asked:
        return float("nan")
    sent = vectors.sparkSession.sparkContext.broadcast({d: (np.array([x for x, _ in q]), unit(pa.array([v for _, v in q], pa.binary()), kind)) for d, q in asked.items()})

    def search(batches):
        for b in batches:
            dims = np.asarray(b.column(1)) if b.num_rows else np.zeros(0)
            for d in np.unique(dims):
                if d not in sent.value:
                    continue
                ids, q = sent.value[d]
                part = b.filter(pa.array(dims == d))
                rep, size = part.column(0).to_numpy(), part.column(3).to_numpy()
                hit = (q @ unit(part.column(2), kind).T >= threshold) & (ids[:, None] != rep[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((hit @ size).astype(np.int64))], ["rep", "n"])

    true = vectors.select("rep", "dim", "vec", "size").mapInArrow(search, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    both = true.where("n > 0").join(counted, "rep", "left").select("n", F.least("n", F.coalesce("links", F.lit(0))).alias("got"))
    total, got, each = both.agg(F.sum("n"), F.sum("got"), F.avg(F.col("got") / F.col("n"))).first()
    return min(got / total, each) if total else float("nan")


def labels(found: DataFrame) -> DataFrame:
    """(rep, component) of all nodes of found(id, component), the smallest of each component too."""
    return found.withColumnRenamed("id", "rep").unionByName(found.select(F.col("component").alias("rep"), "component").distinct())


def near_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, length: int = LIST, seed: int = 5) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Links are pairs found with cosine >= threshold, in double precision. A vector that is null, empty
    or zero, or has null or non-finite components, and one with a null id, links with nothing; so do
    vectors of different dimensions. Equal vectors link, and rows of one id are vectors of their own.
    Ids are integers or cast to them. Components of other types than float are taken as doubles. Only
    the two named columns are read. No rows give no rows.
    """
    ship(table.sparkSession)
    kind = "<f4" if table.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    rows = saved(classes_of(table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")), kind))
    usable = rows.where("vec IS NOT NULL AND vec_id IS NOT NULL")
    width = np.dtype(kind).itemsize
    classes = usable.groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("size")).withColumn("dim", (F.octet_length("vec") / width).cast("int"))
    # Classes get numbers of their own, as two vectors may have one id; writing them fixes the numbers.
    vectors = saved(classes.withColumn("rep", F.monotonically_increasing_id()))
    n = vectors.count()
    graph = saved(shortened(first_lists(vectors, kind, length, n, seed).withColumn("fresh", F.lit(1)), length))
    every = False
    while True:
        if not every:
            graph = descend(vectors, graph, kind, length, n, ROUNDS)
            every = length >= LONGEST_LIST
        edges = graph.where(F.col("s") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        found = components(edges)
        links = cross_links(vectors, graph, labels(found), kind, threshold, length, every)
        label = labels(components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(links)))
        counted = saved(count_links(vectors.join(label, "rep"), kind, threshold, n))
        if every:
            log.info("lists of %d: exact search", length)
            break
        recall = audit(sampled(vectors, n), vectors, counted, kind, threshold)
        if np.isnan(recall):
            closest = graph.groupBy(F.col("u").alias("rep")).agg(F.max("s").alias("s")).orderBy(F.desc("s"), "rep").limit(AUDIT)
            recall = audit(vectors.join(closest.select("rep"), "rep", "left_semi"), vectors, counted, kind, threshold)
        log.info("lists of %d: recall %.4f", length, recall)
        if recall >= RECALL:
            break
        if np.isnan(recall):
            every = True
        else:
            length *= 2
            graph = saved(graph.withColumn("fresh", F.lit(1)))
    unsaved(graph)
    known = vectors.select("vec", "rep", "low", "size").join(label, "rep", "left").join(counted, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(smallest, "component").select("vec", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, "vec", "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component_id")), F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
