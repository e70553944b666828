"""Very many rules against very many texts: the first rule of each kind that matches a text.

Trying each rule on each text is their product. But a text that a rule matches holds the rule's required
literals (the pattern itself, or the literal stretches that every match of a regular expression has), and so
their n-grams. Each literal is looked up by the one of its n-grams that fewest texts and rules share; texts
look up theirs, and only the rules met that way are tried with their real patterns. Rules without a required
literal are tried on all texts, a block of them at a time.

An index of at most SENT_BYTES goes to all tasks, so that texts do not move. A larger one is a table that
the texts' n-grams are joined with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.graph import saved, ship, unsaved

#: Lengths of n-grams; a literal is cut into those of the largest length that fits it.
LENGTHS = (8, 4, 3, 2, 1)
SENT_BYTES = 32 << 20
#: Rules without literals that are tried in one pass over the texts.
BLOCK = 1000

_SPLIT = re.compile(r"[\s,;/()]+")
_U64 = np.uint64
RULE = "id long, kind string, pattern string, match string, priority long, name string, code string"


# Literals and n-grams


def _stretches(tree) -> list[list[str]]:
    """Sets of literals of a parsed expression; every match holds one literal of each set."""
    out, run = [], []

    def close():
        if run:
            out.append(["".join(run)])
            run.clear()

    for op, arg in tree:
        if op is sre.LITERAL:
            run.append(chr(arg))
            continue
        if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            inner = list(arg[3])
            if all(o is sre.LITERAL for o, _ in inner):
                run += [chr(a) for _, a in inner]
                continue
            close()
            out += _stretches(inner)
            continue
        close()
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out += _stretches(arg[2])
        elif op is sre.ATOMIC_GROUP:
            out += _stretches(arg)
        elif op is sre.BRANCH:
            best = [max(_stretches(b), key=_worth, default=None) for b in arg[1]]
            if all(best):
                out.append([x for b in best for x in b])
    close()
    return out


def _worth(literals: list[str]) -> int:
    return min(map(len, literals))


def literals(pattern: str, match: str) -> list[str] | None:
    """What texts hold that the rule matches: one of these at least; [] if that is not known, None if the pattern is none."""
    low = pattern.lower()
    if match != "regex":
        return [low]
    try:
        re.compile(low)
        found = _stretches(sre_parser.parse(low))
    except (re.error, RecursionError, OverflowError):
        return None
    return max(found, key=_worth, default=[])


def _length(literal: str) -> int:
    return next(n for n in LENGTHS if n <= len(literal))


def _hashed(flat: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all stretches of n characters; only the characters and n decide."""
    h = np.full(max(len(flat) - n + 1, 0), n, _U64)
    for j in range(n):
        h = (h ^ flat[j : j + len(h)]) * _U64(0x9E3779B97F4A7C15)
        h ^= h >> _U64(29)
    return h


def grams(texts: list[str], lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of all n-grams of these lengths, each once a text, ascending by text."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U64)
    row = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # characters from here to the text's end
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U64)]
    for n in lengths:
        h = _hashed(flat, n)
        ok = left[: len(h)] >= n
        rows.append(row[: len(h)][ok])
        hashes.append(h[ok])
    rows, hashes = np.concatenate(rows), np.concatenate(hashes).view(np.int64)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


# Trying rules


class Tried:
    """One text, against which rules are tried."""

    def __init__(self, text: str):
        self.low = text.lower()
        self.words = None

    def matches(self, pattern: str, match: str, compiled: dict) -> int | None:
        """0 if the rule matches, 1 if a term matches as a part of a word only, None if it does not."""
        if match == "regex":
            return 0 if _compiled(pattern, compiled).search(self.low) else None
        if match == "exact":
            if self.words is None:
                self.words = set(_SPLIT.split(self.low))
            return 0 if pattern in self.words else None
        if pattern not in self.low:
            return None
        if match == "term":
            return 0 if _compiled(rf"\b{re.escape(pattern)}\b", compiled).search(self.low) else 1
        return 0


def _compiled(pattern: str, compiled: dict) -> re.Pattern:
    if pattern not in compiled:
        if len(compiled) > 10_000:
            compiled.clear()
        compiled[pattern] = re.compile(pattern)
    return compiled[pattern]


# The index


def prepared(rules: DataFrame) -> DataFrame:
    """RULE with `literals`, a row for each different (kind, match, lower-case pattern): the first by (priority descending, id).

    Missing columns are null: match reads as contains, priority as 0, active as true. Inactive rules, those
    without a pattern and regular expressions that are none are left out.
    """
    have = set(rules.columns)
    col = lambda c, kind, default=None: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have and default is not None else F.col(c).cast(kind) if c in have else F.lit(default).cast(kind)
    own = rules.where(col("active", "boolean", True)).select(
        col("id", "long").alias("id"), col("kind", "string", "").alias("kind"), F.lower(col("pattern", "string")).alias("pattern"), col("match", "string", "contains").alias("match"),
        col("priority", "long", 0).alias("priority"), col("name", "string").alias("name"), col("code", "string").alias("code"),
    ).where("pattern <> ''")
    # Equal rules first, by sums that tasks keep in hash tables: a minimum of structs would have them sort all rules.
    same = ["kind", "match", "pattern", "priority", "name", "code"]
    own = own.groupBy(*same, F.isnull("id").alias("none")).agg(F.min("id").alias("id"))
    first = F.min(F.struct((-F.col("priority")).alias("p"), "id", "name", "code")).alias("x")
    once = own.groupBy("kind", "match", "pattern").agg(first).select("x.id", "kind", "pattern", "match", (-F.col("x.p")).alias("priority"), "x.name", "x.code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [p.lower() for p in b.column(2).to_pylist()]
            found = [literals(p, m) for p, m in zip(low, b.column(3).to_pylist())]
            whole = b.set_column(2, "pattern", pa.array(low, pa.string())).append_column("literals", pa.array(found, pa.list_(pa.string())))
            yield whole.filter(pa.array([x is not None for x in found], pa.bool_()))

    ship(rules.sparkSession)
    return _dealt(once).mapInArrow(run, RULE + ", literals array<string>")


def _dealt(df: DataFrame) -> DataFrame:
    """df over all tasks: the rows of a shuffle are few bytes, which would be read in one or two."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _text_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def indexed(rules: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """RULE with `gram` and its length, a row for each literal: the n-gram of it that fewest texts and rules share; null for a rule without a literal."""

    numbers = saved(prepared(rules).withColumn("rule", F.monotonically_increasing_id()))
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_length: dict[int, list[tuple[int, int, str]]] = {}
            for i, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, x in enumerate(own):
                    by_length.setdefault(_length(x), []).append((i, k, x))
            for n, found in by_length.items():
                ids, places, cut_up = zip(*found)
                row, h = grams(list(cut_up), (n,))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[row]), pa.array(np.array(places, np.int32)[row]), pa.array(np.full(len(row), n, np.int32)), pa.array(h)], ["rule", "place", "length", "gram"])

    pieces = saved(numbers.select("rule", "literals").mapInArrow(cut, "rule long, place int, length int, gram long"))
    lengths = _lengths(pieces)
    shared = pieces.groupBy("gram").agg(F.count_distinct("rule").alias("rules"))
    wanted = _sorted_grams(shared)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            h = grams([x.lower() for x in b.column(0).to_pylist()], lengths)[1]
            values, n = np.unique(h if wanted is None else h[_held(h, wanted.value)], return_counts=True)
            for v, c in zip(values.tolist(), n.tolist()):
                total[v] = total.get(v, 0) + c
            if len(total) > 1_000_000:
                yield _counts(total)
                total = {}
        yield _counts(total)

    seen = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    cost = shared.join(seen, "gram", "left").select("gram", (F.coalesce("n", F.lit(0)) * F.col("rules")).alias("cost"))
    best = pieces.join(cost, "gram").groupBy("rule", "place").agg(F.min(F.struct("cost", "gram", "length")).alias("x")).select("rule", "x.gram", "x.length")
    out = saved(numbers.join(best, "rule", "left").drop("rule", "literals"))
    unsaved(numbers, pieces)
    return out


def _lengths(table: DataFrame) -> tuple[int, ...]:
    """The lengths of the n-grams of a table, of LENGTHS."""
    return tuple(r["length"] for r in table.select("length").where("length IS NOT NULL").distinct().collect())


def _counts(total: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["gram", "n"])


def _sorted_grams(table: DataFrame):
    """The grams of a table, sent to all tasks as a sorted array if it is small enough, else None."""
    most = SENT_BYTES // 8
    rows = table.select("gram").distinct().limit(most + 1).toArrow().column("gram").to_numpy()
    return table.sparkSession.sparkContext.broadcast(np.sort(rows)) if len(rows) <= most else None


def _held(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


MATCH = "kind string, part int, priority long, id long, name string, code string"


def _hits(keys: pa.Array, places: list[int], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names)


def first_rules(texts: DataFrame, rules: DataFrame, key: str = "row_id", text: str = "text", index: DataFrame | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(key, kind, part, priority, id, name, code): for each text and kind of rules the first that matches, by (part, priority descending, id).

    rules: id, kind, pattern, match, priority, active, name, code. match: contains; exact (a whole word);
    regex (searched; Python's syntax, one that is none is skipped); term (words of a dictionary: rules that
    match whole words come before those that match parts, which have part 1). Texts and patterns are compared in lower case.
    Texts that nothing matches, and null texts, give no row unless a regular expression matches the empty text;
    rows of one key share one result. No rules or no texts give no rows. Other columns are not read.
    If the key is the text itself, each is tried once, and nothing is gathered afterwards.
    """
    rows = _text_rows(texts, key, text)
    if key == text:
        rows = _dealt(rows.distinct())
    index = indexed(rules, rows) if index is None else index
    kind = f"key {texts.schema[key].dataType.simpleString()}"
    size = index.agg(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("name"), F.lit(0)) + F.coalesce(F.octet_length("code"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    sent = size <= sent_bytes
    found = _tried_where_they_are(rows, index, kind) if sent else _tried_by_join(rows, index, kind)
    if sent and key == text:
        return found.select(F.col("key").alias(key), "kind", "part", "priority", "id", "name", "code")
    order = F.struct("part", (-F.col("priority")).alias("p"), "id", "name", "code")
    best = found.groupBy("key", "kind").agg(F.min(order).alias("x"))
    return best.select(F.col("key").alias(key), "kind", "x.part", (-F.col("x.p")).alias("priority"), "x.id", "x.name", "x.code")


def _tried_where_they_are(rows: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """MATCH of the first rule of each kind, of each row by itself."""
    own = index.toArrow()
    said = own.select(["priority", "id", "name", "code"]).to_pylist()
    known = lambda v, none: (v is not None, none if v is None else v)
    first = sorted(range(len(said)), key=lambda i: (-said[i]["priority"], known(said[i]["id"], 0), known(said[i]["name"], ""), known(said[i]["code"], "")))
    rank = np.empty(len(said), np.int64)
    rank[first] = np.arange(len(said))
    own = own.append_column("rank", pa.array(rank)).sort_by([("gram", "ascending"), ("rank", "ascending")])
    with_gram = own.filter(pc.is_valid(own.column("gram")))
    known = with_gram.column("gram").to_numpy()
    values, starts = np.unique(known, return_index=True)
    sent = rows.sparkSession.sparkContext.broadcast((values, np.append(starts, len(known)), _tuples(with_gram), _tuples(own.filter(pc.is_null(own.column("gram"))))))
    lengths = _lengths(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, starts, listed, always = sent.value
        compiled: dict = {}
        for b in batches:
            tried = [Tried(t) for t in b.column(1).to_pylist()]
            place, h = grams([t.low for t in tried], lengths)
            ok = _held(h, values)
            place, at = place[ok], np.searchsorted(values, h[ok])
            best: dict[tuple[int, str], tuple] = {}
            for p, k in zip(place.tolist(), at.tolist()):
                for rule in listed[starts[k] : starts[k + 1]]:
                    _try_first(tried[p], rule, compiled, p, best)
            for p, t in enumerate(tried):
                for rule in always:
                    _try_first(t, rule, compiled, p, best)
            out = [(kind, part, *rule[3:7]) for (_, kind), (part, _, rule) in best.items()]
            yield _hits(b.column(0), [p for p, _ in best], out, ["key", "kind", "part", "priority", "id", "name", "code"])

    return rows.mapInArrow(run, f"{kind}, {MATCH}")


def _tuples(table: pa.Table) -> list[tuple]:
    return list(zip(*[table.column(c).to_pylist() for c in ("pattern", "match", "kind", "priority", "id", "name", "code", "rank")]))


def _try_first(text: Tried, rule: tuple, compiled: dict, place: int, best: dict) -> None:
    """Put the rule in best[place, kind] = (part, rank, rule) if it matches and comes before the one there; one that cannot come before is not tried."""
    at, rank = (place, rule[2]), rule[7]
    old = best.get(at)
    if old is not None and old[0] == 0 and old[1] <= rank:
        return
    part = text.matches(rule[0], rule[1], compiled)
    if part is not None and (old is None or (part, rank) < old[:2]):
        best[at] = part, rank, rule


def _try(text: Tried, rule: tuple, compiled: dict, place: int, places: list[int], out: list[tuple]) -> None:
    pattern, match, kind, priority, i, name, code = rule
    part = text.matches(pattern, match, compiled)
    if part is not None:
        places.append(place)
        out.append((kind, part, priority, i, name, code))


def _tried_by_join(rows: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    wanted, lengths = _sorted_grams(index.where("gram IS NOT NULL")), _lengths(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, h = grams([t.lower() for t in b.column(1).to_pylist()], lengths)
            if wanted is not None:
                ok = _held(h, wanted.value)
                place, h = place[ok], h[ok]
            for at in range(0, len(h), 10_000):
                cut = pa.array(place[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([b.column(0).take(cut), b.column(1).take(cut), pa.array(h[at : at + 10_000])], ["key", "text", "gram"])

    names = ["key", "kind", "part", "priority", "id", "name", "code"]
    columns = ["key", "text", "pattern", "match", "kind", "priority", "id", "name", "code"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict = {}
        for b in batches:
            places, out, last, tried = [], [], None, None
            for p, (text, *rule) in enumerate(zip(*[b.column(c).to_pylist() for c in columns[1:]])):
                if text != last:
                    last, tried = text, Tried(text)
                _try(tried, tuple(rule), compiled, p, places, out)
            yield _hits(b.column(0), places, out, names)

    out = rows.mapInArrow(probe, f"{kind}, text string, gram long").join(index.where("gram IS NOT NULL"), "gram").select(columns).mapInArrow(verify, f"{kind}, {MATCH}")
    # Rules without a literal: a block of them at a time is tried on all texts.
    held = []
    for rule in index.where("gram IS NULL").toLocalIterator():
        held.append(rule)
        if len(held) == BLOCK:
            out, held = out.unionByName(_tried_where_they_are(rows, _block(index, held), kind)), []
    return out.unionByName(_tried_where_they_are(rows, _block(index, held), kind)) if held else out


def _block(index: DataFrame, rules: list) -> DataFrame:
    return index.sparkSession.createDataFrame(rules, index.schema)


# What a change of rules changes


def changed_rules(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids that were dropped or changed, rules that are new or changed); a rule is told by its id."""
    said = lambda df: df.select("id", F.struct(*sorted(c for c in df.columns if c != "id")).alias("rule"))
    both = said(before).withColumnRenamed("rule", "b").join(said(after).withColumnRenamed("rule", "a"), "id", "full_outer").where("NOT a <=> b")
    return both.where("b IS NOT NULL").select("id"), both.where("a IS NOT NULL").select("id", "a.*")


def redecided(texts: DataFrame, decided: DataFrame, before: DataFrame, after: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """first_rules(texts, after), from decided = first_rules(texts, before), with `again`: whether the text met all rules again.

    Only texts whose deciding rule went or changed do; all others meet the new and changed rules alone,
    which win where they come before the deciding one. What was decided is written out, as it is read
    more than once. Rules are compared only if they decided a text or are the first of their pattern
    now: no other one can decide one.
    """
    decided, now = saved(decided), saved(prepared(after))
    near = saved(decided.select("id").unionByName(now.select("id")).distinct())
    gone, fresh = (saved(x) for x in changed_rules(*(df.join(near, df["id"].eqNullSafe(near["id"]), "left_semi") for df in (before, after))))
    lost = saved(decided.join(gone, "id", "left_semi").select(key).distinct())
    again = first_rules(texts.join(lost, key, "left_semi"), now, key, text).withColumn("again", F.lit(True))
    new = first_rules(texts.join(lost, key, "left_anti"), fresh, key, text)
    both = decided.join(lost, key, "left_anti").unionByName(new)
    best = both.groupBy(key, "kind").agg(F.min(F.struct("part", (-F.col("priority")).alias("p"), "id", "name", "code")).alias("x"))
    return best.select(key, "kind", "x.part", (-F.col("x.p")).alias("priority"), "x.id", "x.name", "x.code", F.lit(False).alias("again")).unionByName(again)
