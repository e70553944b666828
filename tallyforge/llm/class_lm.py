"""Language-model scores with Brown classes (a class-based bigram model).

Words outside white space, with A-Z lower-cased, and one end for each text, which is also the
context of a text's first word. Exchange clustering, in two stages by frequency:

1. The CORE most frequent words go to CLASSES classes: each word in turn moves to the class that most
   raises the likelihood of the class bigrams of all training texts, until none moves.
2. All other common words that occur at least twice move from the class of their form to the class
   that raises that likelihood most, given the classes of their neighbours in stage 1. What counts
   for a word are its neighbours' classes, so this is an aggregate by word and a pass over its rows.

Common words are the COMMON most frequent ones, a fixed number that bounds what is broadcast. Words
that occur once, words that are not common and unseen words belong to one of SHAPES classes by their
last two bytes; the share of words seen once is what a text's unseen words are expected to be
(Good-Turing), so that no other discount is needed. The log10 probability of a token is that of its
class after the class before it, in which PULL tokens are added in proportion to the classes' sizes,
plus that of the word in its class: c / n in an exchange class, (c + 1/2) / (n + (V + 1) / 2) in a
shape class of n tokens and V training words, where an unseen word has c = 0.

Counts of all words of the training texts stay a distributed table. Counts of words that are not
common reach the texts by a join on the word's hash, where no key is frequent. Words are identified
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import NON_SPACE, U64, Words, blocks, mix, signed, text_buffer, unsigned
from tallyforge.llm.common import documents, fold, map_blocks, saved, ship

COMMON = 500_000
CORE = 1000
CLASSES = 48
SHAPES = 32
SWEEPS = 6
PULL = 10.0
HELD_OUT = 1
#: Distinct entries a task gathers before it passes them on.
GATHERED = 1_500_000


def shape(w: Words) -> np.ndarray:
    """Shape class of each word, from its last two bytes."""
    last = w.buf[w.end - 1].astype(U64)
    before = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(U64)
    return (mix(last * U64(256) + before + U64(1)) % U64(SHAPES)).astype(np.int64)


def _merged(parts: list[tuple]) -> list[tuple]:
    """The (key, extra, count) parts as one part with each key once."""
    if len(parts) < 2:
        return parts
    key, extra, n = (np.concatenate(x) for x in zip(*parts))
    key, at, back = np.unique(key, return_index=True, return_inverse=True)
    return [(key, extra[at], np.bincount(back, n, len(key)).astype(np.int64))]


def gathered(batches, count):
    """Sums of what `count(words)` returns, (key, extra, n) arrays, over a task's texts, passed on when they grow large."""
    parts: list[tuple] = []
    for batch in blocks(batches):
        w = Words(*text_buffer(batch.column(0)), NON_SPACE, lower=True)
        parts.append(count(w))
        if sum(len(p[0]) for p in parts) > GATHERED:
            parts = _merged(parts)
            if len(parts[0][0]) > GATHERED // 2:
                yield parts.pop()
    yield from _merged(parts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, shape, c) of every word of the texts."""

    def count(w: Words):
        h, at, n = np.unique(w.hash, return_index=True, return_counts=True)
        return h, shape(w)[at], n

    def run(batches):
        for h, s, n in gathered(batches, count):
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "shape", "c"])

    return texts.mapInArrow(run, "h long, shape int, c long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


class Vocabulary:
    """Sorted hashes and counts of common words; unit: place among the core words, or -1; group: exchange class, or -1."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, core: int):
        rank = np.lexsort((hashes, -counts))
        unit = np.full(len(hashes), -1, np.int32)
        unit[rank[:core]] = np.arange(min(core, len(hashes)))
        order = np.argsort(hashes)
        self.hash, self.count, self.unit = hashes[order], counts[order], unit[order]
        self.group = np.full(len(hashes), -1, np.int16)
        self.core = min(core, len(hashes))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == h, at, -1)

    def _chosen(self, own: np.ndarray, place: np.ndarray, shapes: np.ndarray, first: int) -> np.ndarray:
        got = np.where(place >= 0, own[place], -1) if len(self.hash) else place
        return np.where(got >= 0, got, first + shapes)

    def units(self, place: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """0 .. core - 1: core words; then the shapes."""
        return self._chosen(self.unit, place, shapes, self.core)

    def classes(self, place: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """0 .. CLASSES - 1: exchange classes; then the shapes."""
        return self._chosen(self.group, place, shapes, CLASSES)


def with_ends(w: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' values with `end` after each text, and those before them (`end` at a text's start)."""
    out = np.full(len(values) + len(w.first) - 1, end, np.int64)
    out[np.arange(len(values)) + w.text_of] = values
    before = np.empty_like(out)
    before[:1], before[1:] = end, out[:-1]
    return before, out


def bigrams(texts: DataFrame, vocabulary: Vocabulary, by: str, kinds: int) -> np.ndarray:
    """Counts of one token's unit or class after another's over all texts; `by` is the vocabulary's method, and the end comes after its `kinds` values."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)
    side = kinds + 1

    def run(batches):
        v = sent.value
        if (batch := next(batches, None)) is None:
            return
        total = np.zeros(side * side, np.int64)
        for b in blocks(_chain(batch, batches)):
            w = Words(*text_buffer(b.column(0)), NON_SPACE, lower=True)
            before, after = with_ends(w, getattr(v, by)(v.find(w.hash), shape(w)), side - 1)
            total += np.bincount(before * side + after, minlength=side * side)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    rows = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(side, side)


def contexts(texts: DataFrame, vocabulary: Vocabulary, label: np.ndarray) -> DataFrame:
    """(place, cell, n): how often the common word at `place`, not a core word, comes after class `cell`, or before class cell - A of the A classes."""
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, label))
    groups = int(label.max()) + 1

    def run(batches):
        v, label = sent.value

        def count(w: Words):
            place = v.find(w.hash)
            before, after = with_ends(w, label[v.units(place, shape(w))], groups - 1)
            at = np.arange(len(w)) + w.text_of
            own = np.flatnonzero((place >= 0) & (v.unit[place] < 0) & (v.count[place] > 1)) if len(v.hash) else np.zeros(0, np.int64)
            base = place[own] * (2 * groups)
            key, n = np.unique(np.concatenate([base + before[at[own]], base + groups + after[at[own] + 1]]), return_counts=True)
            return key.astype(np.int64), n, n

        for key, _, n in gathered(batches, count):
            yield pa.RecordBatch.from_arrays([pa.array(key // (2 * groups)), pa.array(key % (2 * groups)), pa.array(n.astype(np.int64))], ["place", "cell", "n"])

    return texts.mapInArrow(run, "place long, cell long, n long")


def best_classes(place: np.ndarray, cell: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the exchange class that most raises the likelihood if the word's tokens join it.

    (place, cell, n) are rows of contexts(), ordered by place; `table` counts class after class. Only
    cells that the word has tokens in matter; of equal classes the first.
    """
    groups = len(table)
    g = lambda x: x * np.log(np.maximum(x, 1))
    key = place * (2 * groups) + cell
    key, back = np.unique(key, return_inverse=True)
    n = np.bincount(back, n)
    place, cell = key // (2 * groups), key % (2 * groups)
    # Rows: a class the word comes after, or before; columns: the classes it may join.
    own = np.concatenate([table[:, :CLASSES], table[:CLASSES].T])
    gain = g(own[cell] + n[:, None]) - g(own[cell])
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    if not len(begin):
        return place, place
    total = np.add.reduceat(gain, begin, axis=0)
    tokens = np.add.reduceat(np.where(cell < groups, n, 0), begin)[:, None]
    size = table[:CLASSES].sum(axis=1)
    return place[begin], np.argmax(total - 2 * (g(size + tokens) - g(size)), axis=1)


def assigned(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(place, class) of each word of contexts(); a word's rows meet in one task, two for each class and task of the pass before."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []

        def judged(x: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best_classes(*x, sent.value)], ["place", "class"])

        for b in batches:
            x = np.concatenate([*held, np.stack([b.column(i).to_numpy() for i in range(3)])], axis=1)
            # The last word may go on in the next batch.
            cut = int(np.searchsorted(x[0], x[0, -1])) if x.shape[1] else 0
            if cut:
                yield judged(x[:, :cut])
            held = [x[:, cut:]]
        if held and held[0].shape[1]:
            yield judged(held[0])

    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(run, "place long, class long")


def _chain(first, rest):
    yield first
    yield from rest


def exchange(b: np.ndarray, core: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: `classes` exchange classes, then each shape and the end as classes of their own."""
    own = len(b) - core
    label = np.concatenate([np.arange(core) % classes, classes + np.arange(own)])
    a = classes + own
    g = lambda x: x * np.log(np.maximum(x, 1))
    one = np.zeros((len(b), a))
    one[np.arange(len(b)), label] = 1
    right, left = b @ one, b.T @ one
    n = one.T @ right
    count = b.sum(axis=1)
    for _ in range(sweeps):
        moved = 0
        for w in range(core):
            old, s = label[w], b[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[old] -= s
            l[old] -= s
            n[old] -= r
            n[:, old] -= l
            n[old, old] -= s
            rows, cols, cell = n[:classes], n[:, :classes].T, n.diagonal()[:classes]
            gain = (g(rows + r) - g(rows)).sum(1) + (g(cols + l) - g(cols)).sum(1)
            k = np.arange(classes)
            gain += g(cell + r[k] + l[k] + s) - g(cell + r[k]) - g(cell + l[k]) + g(cell)
            total = n.sum(axis=1)[:classes]
            gain -= 2 * (g(total + count[w]) - g(total))
            new = int(np.argmax(gain))
            new = old if gain[new] <= gain[old] + 1e-9 else new
            n[new] += r
            n[:, new] += l
            n[new, new] += s
            if new != old:
                moved += 1
                label[w] = new
                right[:, old] -= b[:, w]
                right[:, new] += b[:, w]
                left[:, old] -= b[w]
                left[:, new] += b[w]
        if not moved:
            break
    return label


def class_table(b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Counts of classes after classes from those of units after units."""
    one = np.zeros((len(b), int(label.max()) + 1))
    one[np.arange(len(b)), label] = 1
    return one.T @ b @ one


class ClassModel:
    """step: log10 probability of a class after a class; emit: what every word of a class adds besides log10 of its own count."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray, shapes: np.ndarray, tokens: int, distinct: int):
        self.v, self.tokens, self.distinct = vocabulary, tokens, distinct
        prior = table.sum(axis=0) + 0.5
        prior /= prior.sum()
        self.step = np.log10((table + PULL * prior) / (table.sum(axis=1, keepdims=True) + PULL))
        self.emit = np.zeros(len(table))
        self.emit[:CLASSES] = -np.log10(np.maximum(table[:, :CLASSES].sum(axis=0), 1))
        self.emit[CLASSES:-1] = -np.log10(shapes[:, 0] + 0.5 * (shapes[:, 1] + 1))
        self.end_count = table[:, -1].sum()
        self.base = np.log10(tokens + 0.5 * (distinct + 1))


def fit(docs: DataFrame, counts: DataFrame, text: str = "text", common: int = COMMON, core: int = CORE) -> ClassModel:
    """The model of the texts whose words `counts` counts."""
    spread = sorted(((r["c"], r["count"]) for r in counts.groupBy("c").count().toLocalIterator()), reverse=True)
    least, words = 1 << 62, 0
    for c, n in spread:
        if words + n > common:
            break
        least, words = c, words + n
    top = counts.where(F.col("c") >= least).select("h", "shape", "c").toArrow()  # `common` rows at most
    hashes = unsigned(top.column("h").to_numpy())
    vocabulary = Vocabulary(hashes, top.column("c").to_numpy().astype(np.int64), core)
    texts = docs.select(F.col(text).alias("text"))
    b = bigrams(texts, vocabulary, "units", vocabulary.core + SHAPES)
    label = exchange(b, vocabulary.core)
    inner = vocabulary.unit >= 0
    vocabulary.group[inner] = label[vocabulary.unit[inner]]
    found = assigned(contexts(texts, vocabulary, label), class_table(b, label)).toArrow()
    vocabulary.group[found.column("place").to_numpy()] = found.column("class").to_numpy()
    table = bigrams(texts, vocabulary, "classes", CLASSES + SHAPES)
    shapes = np.zeros((SHAPES, 2))
    for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        shapes[r["shape"]] = r["c"], r["n"]
    ends = int(table[:, -1].sum())
    tokens, distinct = int(shapes[:, 0].sum()) + ends, int(shapes[:, 1].sum()) + (ends > 0)
    place = vocabulary.find(hashes)
    grouped = vocabulary.group[place] >= 0 if len(place) else np.zeros(0, bool)
    np.subtract.at(shapes, top.column("shape").to_numpy()[grouped], np.stack([vocabulary.count[place[grouped]], np.ones(int(grouped.sum()), np.int64)], axis=1))
    return ClassModel(vocabulary, table, shapes, tokens, distinct)


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, h array<long>, n array<int>"


def score_texts(docs: DataFrame, counts: DataFrame, model: ClassModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m: ClassModel = sent.value
        w = Words(*text_buffer(batch.column(3)), NON_SPACE, lower=True)
        place = m.v.find(w.hash)
        group = m.v.classes(place, shape(w))
        before, after = with_ends(w, group, len(m.step) - 1)
        rest = place < 0
        count = m.v.count[place] if len(m.v.hash) else np.zeros(len(place))
        known = np.log10(count + 0.5)
        emitted = m.emit[group] + np.where(rest, 0.0, np.where(group < CLASSES, np.log10(np.maximum(count, 1)), known))
        sums = lambda x, first: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
        tokens = w.counts + 1
        ends = np.concatenate([[0], np.cumsum(tokens)])
        score = sums(m.step[before, after], ends) + sums(emitted, w.first)
        base = sums(np.where(rest, 0.0, known), w.first) + np.log10(m.end_count + 0.5) - tokens * m.base
        n_known = sums(~rest, w.first) + (m.end_count > 0)
        # Words that are not common, with their number in each text, wait for the join.
        h, text = w.hash[rest], w.text_of[rest]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
        offsets = pa.array(np.searchsorted(text[new], np.arange(batch.num_rows + 1)), pa.int32())
        many = np.diff(np.append(new, len(h))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(offsets, pa.array(signed(h[new]))), pa.ListArray.from_arrays(offsets, pa.array(many))],
            ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "h", "n"],
        )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    # Written out once, which also fixes the row numbers.
    local = saved(map_blocks(rows, _SCORED, each))
    waiting = local.select("rid", F.explode(F.arrays_zip("h", "n")).alias("x")).select("rid", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    found = waiting.join(counts.select("h", "c"), "h", "left")
    more = found.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("x"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"))
    x = F.coalesce("x", F.lit(0.0))
    return local.drop("h", "n").join(more, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + x).alias("base_score"), (F.col("score") + x).alias("score"),
    )


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the texts outside fold HELD_OUT and score all rows.

    A null or empty text is one end token. Rows with a null id are scored but not learned from. Equal
    rows are scored alike, each by itself. Ids are integers or cast to them. With nothing to learn from all counts are 0. Only the two
    named columns are read. No rows give no rows.
    """
    ship(docs.sparkSession)
    training = docs.where(fold(doc_id) != HELD_OUT).select(F.col(text).alias("text"))
    counts = saved(word_counts(training))
    return score_texts(docs, counts, fit(training, counts), doc_id, text)


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
