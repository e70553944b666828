"""Benchmark decontamination by a prefix-filtered set join.

An item's text gives windows of ten words (one window if it has fewer). A window is a set of
positioned shingles of up to three words. A document contains a window only if it contains all its
shingles, so a prefix of one shingle decides where to look: the rarest, counted over all documents.
The join looks up that shingle at every document position; its offset in the window gives the only
place the window can begin (positional bound), which must leave room for the window's length
(length bound). What is left is compared word for word.

Benchmark windows are handled in blocks of at most BLOCK_WINDOWS, and a block is what is broadcast:
its size is bounded whatever the benchmark's. Documents never shuffle; each block is one more pass
over their texts in the same stage.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import ALNUM, U64, Words, ranges, same_bytes, signed, text_buffer
from tallyforge.llm.common import documents, map_blocks, saved, unsaved

WINDOW = 10
SHINGLE = 3
#: Windows of benchmark items in one broadcast block (about 150 bytes each).
BLOCK_WINDOWS = 200_000
_SLOTS = 1 << 20


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item string, window string): each window's words joined by one space."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_buffer(batch.column(1)), word=ALNUM, lower=True)
        out_id, out_window = [], []
        for d, name in enumerate(batch.column(0).to_pylist()):
            words = [w.word_bytes(i).decode() for i in range(w.first[d], w.first[d + 1])]
            if name is None or not words:
                continue
            for i in range(max(1, len(words) - window + 1)):
                out_id.append(name)
                out_window.append(" ".join(words[i : i + window]))
        return pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_window, pa.string())], ["item", "window"])

    return map_blocks(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")), "item string, window string", each).distinct()


class WindowIndex:
    """One block of windows, as arrays."""

    def __init__(self, pairs: list[tuple[str, str]], shingle: int):
        texts = sorted({w for _, w in pairs})
        number = {w: i for i, w in enumerate(texts)}
        self.items = sorted({i for i, _ in pairs})
        item_number = {x: i for i, x in enumerate(self.items)}
        links = np.array(sorted((number[w], item_number[i]) for i, w in pairs), np.int64).reshape(-1, 2)
        self.item_of, self.item_first = links[:, 1], np.searchsorted(links[:, 0], np.arange(len(texts) + 1))
        words = Words(*text_buffer(pa.array(texts, pa.string())))
        self.buf, self.start, self.length = words.buf, words.start, words.end - words.start
        self.first, self.n = words.first[:-1], words.counts
        self.hash = words.gram_hash(self.first, self.n)
        # Every shingle of every window: the window, the offset in it and the hash.
        self.size = np.minimum(shingle, self.n)
        many = self.n - self.size + 1
        self.of = np.repeat(np.arange(len(texts)), many)
        at = ranges(self.first, many)
        self.offset = at - self.first[self.of]
        self.shingle = words.gram_hash(at, self.size[self.of])
        self.sizes = [int(z) for z in np.unique(self.size)]

    def candidates(self) -> dict[int, np.ndarray]:
        """Distinct shingles by size, sorted."""
        return {z: np.unique(self.shingle[self.size[self.of] == z]) for z in self.sizes}

    def choose(self, counts: dict[int, int]) -> None:
        """Keep the rarest shingle of each window as its prefix."""
        seen = np.array([counts.get(int(h), 0) for h in signed(self.shingle)], np.int64)
        order = np.lexsort((self.offset, self.shingle, seen, self.of))
        order = order[np.unique(self.of[order], return_index=True)[1]]
        self.prefix = {}
        for z in self.sizes:
            own = order[self.size[self.of[order]] == z]
            own = own[np.argsort(self.shingle[own], kind="stable")]
            keys, first = np.unique(self.shingle[own], return_index=True)
            self.prefix[z] = (keys, np.append(first, len(own)), self.of[own], self.offset[own])
        del self.shingle, self.of, self.offset

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in the block of texts at which a window begins, and which."""
        out_at, out_win = [], []
        for z, (keys, first, window, offset) in self.prefix.items():
            at, h = w.grams(z)
            at, which = find(keys, at, h)
            many = first[which + 1] - first[which]
            entry = ranges(first[which], many)
            win = window[entry]
            begin = np.repeat(at, many) - offset[entry]
            text = np.searchsorted(w.first, np.repeat(at, many), "right") - 1
            ok = (begin >= w.first[text]) & (begin + self.n[win] <= w.first[text + 1])
            begin, win = begin[ok], win[ok]
            ok = w.gram_hash(begin, self.n[win]) == self.hash[win]
            begin, win = begin[ok], win[ok]
            ok = self.exact(w, begin, win)
            out_at.append(begin[ok])
            out_win.append(win[ok])
        return np.concatenate(out_at), np.concatenate(out_win)

    def exact(self, w: Words, begin: np.ndarray, win: np.ndarray) -> np.ndarray:
        n = self.n[win]
        here, there = ranges(begin, n), ranges(self.first[win], n)
        length = self.length[there]
        same = w.end[here] - w.start[here] == length
        same[same] = same_bytes(w.buf, w.start[here][same], self.buf, self.start[there][same], length[same])
        wrong = np.concatenate([[0], np.cumsum(~same)])
        stop = np.cumsum(n)
        return wrong[stop] == wrong[stop - n]


def find(keys: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is among the sorted keys, and the keys' places."""
    bits = np.zeros(_SLOTS, bool)
    bits[keys & U64(_SLOTS - 1)] = True
    maybe = np.flatnonzero(bits[h & U64(_SLOTS - 1)])
    place = np.searchsorted(keys, h[maybe])
    place[place == len(keys)] = 0
    good = keys[place] == h[maybe] if len(keys) else np.zeros(0, bool)
    return at[maybe[good]], place[good]


def shingle_counts(docs: DataFrame, keys: dict[int, np.ndarray], text: str) -> dict[int, int]:
    """How often each of the given shingles occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_buffer(batch.column(0)), word=ALNUM, lower=True)
        out_h, out_n = [], []
        for z, own in sent.value.items():
            _, which = find(own, *w.grams(z))
            n = np.bincount(which, minlength=len(own))
            hit = np.flatnonzero(n)
            out_h.append(own[hit])
            out_n.append(n[hit])
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out_h))), pa.array(np.concatenate(out_n).astype(np.int64))], ["h", "n"])

    counted = map_blocks(docs.select(F.col(text).alias("text")), "h long, n long", each).groupBy("h").agg(F.sum("n").alias("n"))
    return {r["h"]: r["n"] for r in counted.toLocalIterator()}


_HITS = "doc_id long, text string, hits array<long>, items array<string>"
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, hits array<long>"


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, carry: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted), hits.

    carry: columns of docs to take along, and the names they get.

    hits holds pairs of word positions [from, to), merged and in order. A null text has no words; a
    null or empty item, or one without an id, has no windows; an id given to several items joins
    their windows; equal rows each get a row; empty tables give no rows or no hits. Ids of documents
    are integers or cast to them. Only the named columns are read, so others may bear any name.
    """
    windows = item_windows(items, item_id, item_text, window)
    n = windows.select("window").distinct().count()
    blocks = max(1, -(-n // block_windows))
    number = F.pmod(F.xxhash64("window"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    windows = windows.withColumn("block", number)
    windows = saved(windows) if blocks > 1 else windows
    carry = carry or {}
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"),
        *(F.col(f"`{c}`").alias(x) for c, x in carry.items()),
    )
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in out.schema[4:])
    for b in range(blocks):
        pairs = [(r["item"], r["window"]) for r in windows.where(F.col("block") == b).toLocalIterator()]
        index = None
        if pairs:
            index = WindowIndex(pairs, shingle)
            index.choose(shingle_counts(rows, index.candidates(), "text"))
        out = map_blocks(out, (_OUT if b == blocks - 1 else _HITS) + more, _pass(docs.sparkSession.sparkContext.broadcast(index), b == blocks - 1))
    if blocks > 1:
        unsaved(windows)
    return out


def _pass(sent, last: bool):
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        index: WindowIndex | None = sent.value
        w = Words(*text_buffer(batch.column(1)), word=ALNUM, lower=True)
        n = batch.num_rows
        cover = np.zeros(len(w) + 1, np.int32)
        had = batch.column(2)
        before, first = had.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2), had.value_lengths().to_numpy() // 2
        base = np.repeat(w.first[:-1], first)
        np.add.at(cover, before[:, 0] + base, 1)
        np.add.at(cover, before[:, 1] + base, -1)
        items = batch.column(3).to_pylist()
        if index is not None:
            at, win = index.occurrences(w)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + index.n[win], -1)
            text = np.searchsorted(w.first, at, "right") - 1
            many = index.item_first[win + 1] - index.item_first[win]
            pair = np.unique(np.repeat(text, many) * len(index.items) + index.item_of[ranges(index.item_first[win], many)])
            for t, i in zip(*np.divmod(pair, len(index.items))):
                items[t].append(index.items[i])
        hit = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        # Runs of hit words, cut at text borders.
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        cut = w.first[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(w))])
        cut = cut[hit[cut] & hit[cut - 1]]
        start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
        stop = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
        text = np.searchsorted(w.first, start, "right") - 1
        spans = np.stack([start, stop], 1) - w.first[text][:, None]
        offsets = 2 * np.searchsorted(text, np.arange(n + 1))
        hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(spans.reshape(-1).astype(np.int64)))
        items = [sorted(set(x)) for x in items]
        listed = pa.array(items, pa.list_(pa.string()))
        if not last:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hits, listed, *batch.columns[4:]], ["doc_id", "text", "hits", "items", *batch.schema.names[4:]])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(w.counts.astype(np.int64)), pa.array((total[w.first[1:]] - total[w.first[:-1]]).astype(np.int64)), pa.array([len(x) for x in items], pa.int64()), listed, hits, *batch.columns[4:]],
            ["doc_id", "n_words", "n_hit", "n_items", "items", "hits", *batch.schema.names[4:]],
        )

    return each


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window; nothing is shuffled."""
    carry = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    found = decontaminate(docs, items, doc_id, text, carry=carry, **options).where("n_hit = 0")
    return found.select(*(F.col(x).alias(c) for c, x in carry.items()))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS x
  FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(s) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(s, s + n - 1)) AS t(p) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(k, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
