"""A Merkle manifest of a dataset: one root for all rows, and for each row a proof that it belongs there.

Rows become leaves; the leaves of a tree are ordered, and of each level every ARITY consecutive nodes (the last
run may have fewer, even one) become their parent until one node is left. The last nodes of all trees are
the leaves of one more tree, TOP, whose last node is the root.

A forest fragment is a set of nodes keyed by (tree, level, index). Fragments merge by union; as the leaves
of each tree have been counted, it is known how many nodes each run has, and whenever a run is complete it
is replaced by its parent. Merging is associative and commutative, so it does not matter which task holds
which leaves, and a fragment of a stretch of leaves keeps fewer than 2 * ARITY nodes a level. Tasks merge the leaves
they read, then fragments merge a few neighbours at a time until one is left. Completed runs are written
as they appear: they are all the siblings that proofs need.

Proofs go the other way: leaves meet the completed runs in aligned blocks of ARITY ** BLOCK_LEVELS leaves,
each with the path of its block, which is found in the same way among the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import documents, saved, ship, unsaved
from tallyforge.llm.numbering import numbered

ARITY, BLOCK_LEVELS = 8, 3
TOP = -1
#: The index under which the root itself is written.
ROOT = -1
#: Fragments that merge into one in a round.
FAN = 8

#: done: a run of children under (tree, level, index); else a node that waits for its siblings.
NODES = "done boolean, tree long, level int, index long, size long, digests array<string>"
LEAVES = "tree long, index long, size long, leaf string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value under a length: `-` for null, else its UTF-8 byte count, `:` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of all values, each under its length."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


class Forest:
    """A fragment: nodes that wait for their siblings, by run. size: leaves of the node's tree; trees: how many there are."""

    def __init__(self, trees: int):
        self.trees = trees
        self.waiting: dict[tuple[int, int, int], tuple[int, dict[int, str]]] = {}

    def add(self, tree: int, level: int, index: int, size: int, value: str) -> Iterator[tuple]:
        """Put a node in; the runs that are complete by it come out."""
        while True:
            nodes = -(-size // ARITY**level)  # of this level
            if nodes == 1:
                if tree == TOP:
                    yield True, TOP, level, ROOT, size, [value]
                    return
                tree, level, index, size = TOP, 0, tree, self.trees
                continue
            run = index // ARITY
            _, own = self.waiting.setdefault((tree, level, run), (size, {}))
            own[index % ARITY] = value
            if len(own) < min(ARITY, nodes - run * ARITY):
                return
            del self.waiting[tree, level, run]
            children = [own[i] for i in sorted(own)]
            level, index, value = level + 1, run, digest("".join(children))
            yield True, tree, level, index, size, children

    def rest(self) -> Iterator[tuple]:
        for (tree, level, run), (size, own) in self.waiting.items():
            for i, value in own.items():
                yield False, tree, level, run * ARITY + i, size, [value]


_ARROW = {"done": pa.bool_(), "tree": pa.int64(), "level": pa.int32(), "index": pa.int64(), "size": pa.int64(), "digests": pa.list_(pa.string())}


def _batch(rows: list[tuple], part: int | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    arrays = [pa.array(c, t) for c, t in zip(columns, _ARROW.values())]
    names = list(_ARROW)
    if part is not None:
        arrays.append(pa.array([part] * len(rows), pa.int64()))
        names.append("part")
    return pa.RecordBatch.from_arrays(arrays, names)


def grown(leaves: DataFrame, trees: int) -> list[DataFrame]:
    """Tables of the completed runs (tree, level, index, digests) of a forest over LEAVES; the root is the run above TOP's last node."""
    spark = leaves.sparkSession
    ship(spark)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forest, part = Forest(trees), TaskContext.get().partitionId()
        for b in batches:
            rows = [run for row in zip(*[b.column(n).to_pylist() for n in ("tree", "index", "size", "leaf")]) for run in forest.add(row[0], 0, *row[1:])]
            if rows:
                yield _batch(rows, part)
        yield _batch(list(forest.rest()), part)

    def merge(table: pa.Table) -> pa.Table:
        forest = Forest(trees)
        rows = []
        for tree, level, index, size, digests in zip(*[table.column(n).to_pylist() for n in ("tree", "level", "index", "size", "digests")]):
            rows += forest.add(tree, level, index, size, digests[0])
        rows += forest.rest()
        return pa.Table.from_batches([_batch(rows, table.column("part")[0].as_py())])

    step = saved(leaves.select("tree", "index", "size", "leaf").mapInArrow(plant, NODES + ", part long"))
    out = [step]
    while True:
        left = step.where("NOT done")
        if not left.limit(1).count():
            return [t.where("done").select("tree", "level", "index", "digests") for t in out]
        step = saved(left.withColumn("part", F.call_function("div", F.col("part"), F.lit(FAN))).groupBy("part").applyInArrow(merge, NODES + ", part long"))
        out.append(step)


def _side(digests: list[str], at: int) -> tuple[str, str]:
    return "".join(digests[:at]), "".join(digests[at + 1 :])


def paths(nodes: DataFrame, runs: DataFrame, level: int, above: DataFrame | None) -> DataFrame:
    """nodes (tree, index, ...) of one level with `left` and `right`: the siblings on each side, level by level up to the tree's last node.

    runs: all completed runs of these trees. above: (tree, block, left, right) paths of the blocks, or None where no tree is higher than a block.
    Nodes meet the runs of their own block of ARITY ** BLOCK_LEVELS nodes, and one path: groups of bounded size.
    """
    width = ARITY**BLOCK_LEVELS
    up = F.col("level") - level  # 1 for the runs whose children the nodes are
    block = F.call_function("div", F.col("index") * F.pow(F.lit(ARITY), up).cast("long"), F.lit(width))
    near = runs.where((F.col("level") > level) & (F.col("level") <= level + BLOCK_LEVELS)).select("tree", block.alias("block"), F.col("level").alias("up"), F.col("index").alias("run"), "digests")
    none = F.lit(None).cast("array<string>")
    context = near.select("tree", "block", (F.col("up") - level).cast("int").alias("up"), "run", "digests", none.alias("right"))
    if above is not None:
        context = context.unionByName(above.select("tree", "block", F.lit(0).alias("up"), F.lit(0).cast("long").alias("run"), F.col("left").alias("digests"), "right"))
    own = nodes.withColumn("block", F.call_function("div", F.col("index"), F.lit(width)))
    kept = nodes.columns

    def join(rows: pa.Table, context: pa.Table) -> pa.Table:
        found, top = {}, ([], [])
        for up, run, digests, right in zip(*[context.column(n).to_pylist() for n in ("up", "run", "digests", "right")]):
            if up:
                found[up, run] = digests
            else:
                top = digests, right
        lefts, rights = [], []
        for index in rows.column("index").to_pylist():
            left, right = [], []
            for up in range(1, BLOCK_LEVELS + 1):
                run = found.get((up, index // ARITY))
                if run is None:
                    break
                a, b = _side(run, index % ARITY)
                left.append(a)
                right.append(b)
                index //= ARITY
            lefts.append(left + top[0])
            rights.append(right + top[1])
        out = rows.select(kept)
        return out.append_column("left", pa.array(lefts, pa.list_(pa.string()))).append_column("right", pa.array(rights, pa.list_(pa.string())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return own.groupBy("tree", "block").cogroup(context.groupBy("tree", "block")).applyInArrow(join, kinds + ", left array<string>, right array<string>")


def proofs(leaves: DataFrame, runs: DataFrame, largest: int, level: int = 0) -> DataFrame:
    """leaves (tree, index, ...) with `left` and `right` up to the last node of their trees, of which the largest has `largest` leaves."""
    width = ARITY**BLOCK_LEVELS
    above = None
    if largest > width:
        blocks = leaves.select("tree", F.call_function("div", F.col("index"), F.lit(width)).alias("index")).distinct()
        above = proofs(blocks, runs, -(-largest // width), level + BLOCK_LEVELS).withColumnRenamed("index", "block")
    return paths(leaves, runs, level, above)


def manifest(rows: DataFrame, values: list[str], group: str, order: str, tampered: Column | None = None, text: str | None = None) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    values: the columns a leaf says. group: the column whose values have a tree each; trees are ordered by
    it, null first, bytewise. Leaves ascend by `order`, nulls first, then by leaf; equal rows are leaves each.
    tampered and text: the condition under which, for the check alone, column `text` is read as its lower
    case (A-Z); null counts as no. An empty table gives no rows; a text of any length and other columns are no matter.
    """
    spark = rows.sparkSession
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if text else None
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf(*[lower if v == text else F.col(v) for v in values])) if text and tampered is not None else F.lit(None).cast("string")
    small = saved(rows.select(F.col(order).alias("order"), F.col(group).alias("group"), leaf(*[F.col(v) for v in values]).alias("leaf"), changed.alias("changed")))
    placed = numbered(small, [F.asc_nulls_first("group"), F.asc_nulls_first("order"), F.col("leaf")], "row")
    unsaved(small)
    groups = saved(placed.groupBy("group").agg(F.min("row").alias("first"), F.count("*").alias("size")))
    ordered = saved(numbered(groups, [F.asc_nulls_first("group")], "tree"))
    unsaved(groups)
    trees, largest = ordered.agg(F.count("*"), F.max("size")).first()
    schema = f"`{order}` {rows.schema[order].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not trees:
        return spark.createDataFrame([], schema)
    # Groups are few as a rule, and Spark broadcasts them then; if not, adaptive execution splits the rows of a large group.
    own = placed.alias("p").join(ordered.alias("g"), F.col("p.group").eqNullSafe(F.col("g.group")))
    leaves = saved(own.select("tree", (F.col("row") - F.col("first")).alias("index"), "size", "leaf", "order", "changed"))
    nodes = _united(grown(leaves, trees))
    root = nodes.where(F.col("index") == ROOT).first()["digests"][0]
    runs, upper = nodes.where("tree >= 0"), nodes.where((F.col("tree") == TOP) & (F.col("index") >= 0))
    top = proofs(ordered.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index")), upper, trees)
    # The path from a tree's last node to the root, and that node itself: the parent of the tree's last run, or its only leaf.
    last = runs.where("index = 0").groupBy("tree").agg(F.max_by("digests", "level").alias("run"))
    only = leaves.where("size = 1").select("tree", F.col("leaf").alias("alone"))
    top = saved(top.select(F.col("index").alias("tree"), F.col("left").alias("top_left"), F.col("right").alias("top_right")).join(last, "tree", "left").join(only, "tree", "left").select("tree", "top_left", "top_right", F.coalesce(F.sha2(F.array_join("run", "").cast("binary"), 256), "alone").alias("subroot")))
    own = proofs(leaves.select("tree", "index", "leaf", "order", "changed"), runs, largest).join(top, "tree")
    left, right = F.concat("left", "top_left"), F.concat("right", "top_right")
    sides = F.arrays_zip(left.alias("l"), right.alias("r"))
    folded = F.aggregate(sides, F.coalesce("changed", "leaf"), lambda at, s: F.sha2(F.concat(s["l"], at, s["r"]).cast("binary"), 256))
    proof = F.sha2(F.array_join(F.transform(sides, lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)
    out = own.select(F.col("order").alias(order), "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, a tree for each language, checked with texts tampered where 3 divides crc32(doc_id)."""
    docs = documents(spark, sf_dir).select(FIELDS)
    return manifest(docs, FIELDS, "lang", "doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, "text")


def _op13_sql(levels: int = 14) -> str:
    from tallyforge.llm.sharding import crc32_sql

    part = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"
    plain = {c: part(c, f"{c}::VARCHAR") for c in FIELDS}
    lower = part("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    said = " || ".join(plain.values())
    changed = " || ".join([*list(plain.values())[:-1], lower])
    sql = f"""
WITH leaves AS (
  SELECT doc_id, lang, sha256({said}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32_sql("coalesce(doc_id, 0)::VARCHAR")} % 3 = 0 THEN sha256({changed}) ELSE sha256({said}) END AS seen FROM documents),
rows AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
"""

    def tree(name: str, start: str) -> str:
        """CTEs name0 .. nameN: nodes of each level with their siblings on both sides; a tree's last node stays alone on its level."""
        out = f"{name}0 AS ({start}),\n"
        for k in range(levels):
            out += f"{name}{k + 1} AS (SELECT tree, i // {ARITY} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + {ARITY - 1}) // {ARITY} AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, i // {ARITY}, n),\n"
        out += f"{name} AS (" + " UNION ALL ".join(f"SELECT {k} AS level, * FROM {name}{k}" for k in range(levels + 1)) + "),\n"
        out += f"{name}_sides AS (SELECT level, tree, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY level, tree, i // {ARITY} ORDER BY i)),\n"
        return out

    sql += tree("a", "SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM rows")
    sql += "sub AS (SELECT tree, h AS subroot FROM a WHERE n = 1),\n"
    sql += tree("b", "SELECT 0::BIGINT AS tree, tree AS i, subroot AS h, count(*) OVER () AS n FROM sub")
    sql += "root AS (SELECT h AS root FROM b WHERE n = 1),\n"
    sql += "f0 AS (SELECT doc_id, tree, i AS place, leaf, seen AS h, '' AS proof FROM rows),\n"
    side = "f0"
    for name, at, tree_id in (("a", "place", "f.tree"), ("b", "tree", "0")):
        for k in range(levels):
            new = f"{name}f{k + 1}"
            sql += f"{new} AS (SELECT f.doc_id, f.tree, f.place, f.leaf, CASE WHEN s.l IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, f.proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof FROM {side} f LEFT JOIN {name}_sides s ON s.level = {k} AND s.tree = {tree_id} AND s.i = f.{at} // {ARITY**k}),\n"
            side = new
    return sql.rstrip().rstrip(",") + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM {side} JOIN sub USING (tree), root"


OP13_SQL = _op13_sql()
