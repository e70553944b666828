"""Removal of repeated passages with sharded Aho-Corasick automata.

A passage recurs if SIZE consecutive words of it also start somewhere else. Confirming and locating
are separate, and none of it lists every window of the corpus:

1. Units. A window's anchor is the smallest hash among its GRAM-word shingles (the leftmost of
   equals). Windows of a text that follow one another and share an anchor are a unit. Equal windows
   have equal anchors, so only units whose anchor occurs twice matter.
2. Confirming. A unit whose word sequence occurs twice recurs. Where a unit occurs once though its
   anchor does not, the windows of all units with that anchor are counted, and the runs of windows
   that occur twice recur. Sequences are told apart by 128-bit hashes here.
3. The table of passages: the words of one occurrence of each confirmed unit or run. Units that follow
   one another in a text share most of their words, and are sent as one chain.
4. Locating. Texts lie in buckets. A bucket gets, from that table, the passages that may occur in it,
   compiles them into automata of at most SHARD_WORDS words, one character standing for a word, and
   all its texts stream through them. What an automaton finds is removed, and nothing else: words
   are compared byte by byte, and the hashes only say which passages to look for where.

Buckets hold about BUCKET_BYTES of text, so their number grows with the corpus; what is sent to a
bucket is distinct, so a passage that very many texts share reaches it once.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import BLOCK_BYTES, NON_SPACE, U64, Words, blocks, mix, ranges, same_bytes, signed, text_buffer
from tallyforge.llm.common import documents, give_back, map_blocks, saved, ship, text_bytes, unsaved

SIZE = 35
GRAM = 8
BUCKET_BYTES = 4 << 20
SHARD_WORDS = 250_000
#: Units sent as one text.
CHAIN = 16
#: Bytes of passages whose words are numbered together; so many hold fewer distinct words than there are letters.
ALPHABET_BYTES = 3 << 20


class Units:
    """The units of a block of texts: first and last window, anchor, and two hashes of the word sequence."""

    def __init__(self, w: Words, size: int, gram: int):
        self.w, self.size = w, size
        none = np.zeros(0, np.int64)
        last = np.repeat(w.first[1:], w.counts) - size
        at = np.flatnonzero(np.arange(len(w)) <= last)
        if not len(at):
            self.first, self.last = none, none
            self.anchor, self.unit, self.check = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64)
            return
        g = w.gram_hash(np.arange(len(w) - gram + 1), gram)
        # Place of the smallest shingle hash of each run of size - gram + 1 shingles, by doubling.
        need, have = size - gram + 1, 1
        low = np.arange(len(g))
        while have < need:
            step = min(have, need - have)
            here, there = low[:-step], low[step:]
            low = np.where(g[there] < g[here], there, here)
            have += step
        place = low[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.last = at[begin], at[np.append(begin[1:], len(at)) - 1]
        self.anchor = g[place[begin]]
        self.unit = w.gram_hash(self.first, self.words)
        self.check = w.gram_hash(self.first, self.words, True)

    @property
    def words(self) -> np.ndarray:
        return self.last + self.size - self.first


def _member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each h in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, at, -1)


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(signed(c) if c.dtype == U64 else c.astype(np.int64)) for c in columns]


def _texts(table):
    """(from, to, words) of the packed texts of a table or batch, in blocks of bounded size."""
    unpack = zstandard.ZstdDecompressor()
    packed, sizes = table.column("packed").to_pylist(), table.column("bytes").to_numpy()
    at = 0
    while at < len(packed):
        to, total = at, 0
        while to < len(packed) and (to == at or total + sizes[to] <= BLOCK_BYTES):
            total += sizes[to]
            to += 1
        texts = pa.array([unpack.decompress(x, int(n)) if n else b"" for x, n in zip(packed[at:to], sizes[at:to])], pa.binary())
        yield at, to, Words(*text_buffer(texts.cast(pa.string())), NON_SPACE)
        at = to


def packed_rows(rows: DataFrame, schema: str, others: list[str]) -> DataFrame:
    """rows(p, text, others) with the text as packed bytes and its length."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1)
        raw, off = text_buffer(batch.column(1))
        data = raw.tobytes()
        packed = [z.compress(data[a:b]) for a, b in zip(off[:-1], off[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(np.diff(off)), *batch.columns[2:]], ["p", "packed", "bytes", *others])

    return map_blocks(rows, schema, pack)


def unit_rows(packed: DataFrame, size: int, gram: int) -> DataFrame:
    """(a, u, v, p, n): anchor, both hashes and bucket of the units, counted by block of texts."""

    def run(batches):
        for batch in batches:
            p = batch.column(0).to_numpy()
            for at, _, w in _texts(batch):
                x = Units(w, size, gram)
                own = p[at + np.searchsorted(w.first, x.first, "right") - 1]
                _, one, n = np.unique(mix(x.unit ^ own.astype(U64)) ^ x.check, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(_longs(x.anchor[one], x.unit[one], x.check[one], own[one], n), ["a", "u", "v", "p", "n"])
        give_back()

    return packed.select("p", "packed", "bytes").mapInArrow(run, "a long, u long, v long, p long, n long")


_GIVEN = "u long, v long, p long, n long, counted boolean, us array<long>, vs array<long>, at array<int>, words array<int>, text string"


def _lists(values: np.ndarray, begin: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)), pa.int32()), pa.array(values, kind))


def unit_texts(packed: DataFrame, wanted: DataFrame, size: int, gram: int) -> DataFrame:
    """The words of one occurrence of each unit in wanted(p, u, v, n, counted).

    Units to be counted are rows of their own. Those that recur (n > 1) come in chains of CHAIN units
    at most that follow one another in a text: a row with the hashes of the first, those of all, the
    place and words of each in the chain, and the chain's words, so that what units share is sent once.
    """

    def cut(texts: pa.Table, units: pa.Table) -> pa.Table:
        give_back()
        u, v, n = (units.column(c).to_numpy() for c in ("u", "v", "n"))
        counted = units.column("counted").to_numpy().astype(bool)
        key = mix(u.view(U64)) ^ v.view(U64)
        order = np.argsort(key)
        left = np.ones(len(u), bool)
        out = []
        for _, _, w in _texts(texts) if len(u) else ():
            x = Units(w, size, gram)
            at = _member(key[order], mix(x.unit) ^ x.check)
            have = np.flatnonzero(at >= 0)
            row, one = np.unique(order[at[have]], return_index=True)
            have, row = have[one][left[row]], row[left[row]]
            left[row] = False
            by_place = np.argsort(have)
            have, row = have[by_place], row[by_place]
            single, chained = have[counted[row]], have[n[row] > 1]
            one, many = row[counted[row]], row[n[row] > 1]
            text_of = np.searchsorted(w.first, x.first[chained], "right")
            new = np.ones(len(chained), bool)
            new[1:] = (chained[1:] != chained[:-1] + 1) | (text_of[1:] != text_of[:-1])
            run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            new |= (np.arange(len(new)) - run) % CHAIN == 0
            begin = np.flatnonzero(new)
            start = x.first[chained[begin]]
            stop = x.last[chained[np.append(begin[1:], len(chained)) - 1]] + size if len(begin) else start
            places = x.first[chained] - np.repeat(start, np.diff(np.append(begin, len(chained))))
            none = _lists(np.zeros(0, np.int64), np.zeros(len(single), np.int64), pa.int64())
            short = none.cast(pa.list_(pa.int32()))
            head = lambda at, count, flag: [*_longs(u[at], v[at]), pa.array(np.full(len(at), p)), *_longs(count), pa.array(np.full(len(at), flag))]
            p = units.column("p")[0].as_py()
            out.append(pa.RecordBatch.from_arrays([*head(one, n[one], True), none, none, short, short, w.joined(x.first[single], x.words[single])], names))
            out.append(pa.RecordBatch.from_arrays([*head(many[begin], n[many[begin]], False), _lists(u[many], begin, pa.int64()), _lists(v[many], begin, pa.int64()), _lists(places, begin, pa.int32()), _lists(x.words[chained], begin, pa.int32()), w.joined(start, stop - start)], names))
        return pa.Table.from_batches(out, schema)

    names = ["u", "v", "p", "n", "counted", "us", "vs", "at", "words", "text"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.bool_(), longs, longs, ints, ints, pa.string()])))
    return packed.select("p", "packed", "bytes").groupBy("p").cogroup(wanted.groupBy("p")).applyInArrow(cut, _GIVEN)


def _windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and first word of each window, in order, of texts that are units."""
    count = w.counts - size + 1
    text = np.repeat(np.arange(len(count)), count)
    at = ranges(w.first[:-1], count)
    return text, at, at - w.first[text]


def window_rows(units: DataFrame, size: int) -> DataFrame:
    """(h, k, u, v, p, at, n) of the windows of units(u, v, p, n, text); `at` is the place in the unit."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_buffer(batch.column(4)), NON_SPACE)
        text, at, place = _windows(w, size)
        u, v, p, n = (batch.column(i).to_numpy()[text] for i in range(4))
        return pa.RecordBatch.from_arrays(_longs(w.gram_hash(at, size), w.gram_hash(at, size, True), u, v, p, place, n), ["h", "k", "u", "v", "p", "at", "n"])

    return map_blocks(units.select("u", "v", "p", "n", "text"), "h long, k long, u long, v long, p long, at long, n long", each)


def run_rows(units: DataFrame, size: int) -> DataFrame:
    """(p, u, v, words, text): the runs of consecutive places in units(p, places, text), as passages with hashes of their own."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_buffer(batch.column(2)), NON_SPACE)
        places = batch.column(1)
        text = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
        at = places.flatten().to_numpy() + w.first[text]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        start, words = at[begin], at[np.append(begin[1:], len(at)) - 1] + size - at[begin]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[begin])), *_longs(w.gram_hash(start, words), w.gram_hash(start, words, True), words), w.joined(start, words)], ["p", "u", "v", "words", "text"])

    return map_blocks(units.select("p", "places", "text"), "p long, u long, v long, words long, text string", each)


def _letters(code: np.ndarray) -> str:
    """A string with one character for each number; surrogates are left out."""
    return np.where(code >= 0xD800, code + 0x800, code).astype("<u4").tobytes().decode("utf-32-le")


class Alphabet:
    """Numbers from 1 for the distinct words of some passages; words are the same if their bytes are."""

    def __init__(self, w: Words):
        self.w = w
        self.keys, self.at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        self.own = back + 1
        self.by_bytes: dict[bytes, int] | None = None
        one = self.at[back]
        if not self._same(w, np.arange(len(w)), one).all():  # two words of one hash: number them by their bytes
            self.by_bytes = {}
            self.own = np.array([self.by_bytes.setdefault(w.word_bytes(i), len(self.by_bytes) + 1) for i in range(len(w))])

    def _same(self, w: Words, of: np.ndarray, one: np.ndarray) -> np.ndarray:
        size = w.end[of] - w.start[of]
        out = size == self.w.end[one] - self.w.start[one]
        out[out] = same_bytes(w.buf, w.start[of][out], self.w.buf, self.w.start[one][out], size[out])
        return out

    def codes(self, w: Words) -> np.ndarray:
        """The number of each word, 0 for one that no passage has."""
        place = _member(self.keys, w.hash)
        have = np.flatnonzero(place >= 0)
        out = np.zeros(len(w), np.int64)
        if self.by_bytes is not None:
            out[have] = [self.by_bytes.get(w.word_bytes(i), 0) for i in have]
            return out
        out[have] = np.where(self._same(w, have, self.at[place[have]]), place[have] + 1, 0)
        return out


def _cuts(words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive passages of at most `most` words together, or of one passage."""
    total, out, at = np.concatenate([[0], np.cumsum(words)]), [], 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def _stretches(w: Words, code: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of at least `size` words of passages within one text; nothing else can hold a passage."""
    border = np.zeros(len(w) + 1, bool)
    border[w.first] = True
    inside = code > 0
    begin = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stop = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    enough = stop - begin >= size
    return list(zip(begin[enough].tolist(), stop[enough].tolist()))


def locate(texts: list[Words], chains: pa.Table, shard_words: int = SHARD_WORDS, size: int = SIZE) -> list[np.ndarray]:
    """For each block of texts, which words an occurrence of a passage covers.

    A chain's text holds passages of words[i] words, `size` at least, that begin at its word at[i].
    """
    cover = [np.zeros(len(w) + 1, np.int64) for w in texts]
    for part in blocks(iter(chains.combine_chunks().to_batches()), limit=ALPHABET_BYTES):
        own = Words(*text_buffer(part.column("text")), NON_SPACE)
        alphabet = Alphabet(own)
        streams = [(_letters(code), _stretches(w, code, size)) for w in texts for code in [alphabet.codes(w)]]
        line = _letters(alphabet.own)
        begin = part.column("at").flatten().to_numpy() + np.repeat(own.first[:-1], part.column("at").value_lengths().to_numpy())
        words = part.column("words").flatten().to_numpy()
        for x, y in _cuts(words, shard_words):
            automaton = ahocorasick.Automaton()
            for i, n in zip(begin[x:y].tolist(), words[x:y].tolist()):
                automaton.add_word(line[i : i + n], n)
            automaton.make_automaton()
            for (stream, stretches), c in zip(streams, cover):
                found = np.fromiter(chain.from_iterable(x for i, j in stretches for x in automaton.iter(stream, i, j)), np.int64).reshape(-1, 2)
                np.add.at(c, found[:, 0] + 1 - found[:, 1], 1)
                np.add.at(c, found[:, 0] + 1, -1)
    return [np.cumsum(c[:-1]) > 0 for c in cover]


def confirmed_passages(packed: DataFrame, size: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """passages(u, v, at, words, text), chains of confirmed passages, each passage once; and places(p, u, v), the buckets that chains may occur in."""
    units = saved(unit_rows(packed, size, gram))
    twice = units.groupBy("a").agg(F.sum("n").alias("na")).where("na > 1").select("a")
    shared = saved(units.join(twice, "a").groupBy("a", "u", "v", "p").agg(F.sum("n").alias("n")))
    unsaved(units)
    whole = shared.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min("p").alias("giver"))
    judged = saved(shared.drop("n").join(whole, ["u", "v"]))
    unsaved(shared)
    # Units of which one occurrence is read: those that recur, and those that occur once.
    given = judged.where("p = giver")
    doubtful = judged.where("n = 1").select("a").distinct().withColumn("counted", F.lit(True))
    again = given.where("n > 1").join(doubtful, "a", "left").select("p", "u", "v", "n", F.coalesce("counted", F.lit(False)).alias("counted"))
    once = given.where("n = 1").select("p", "u", "v", "n", F.lit(True).alias("counted"))
    texts = saved(unit_texts(packed, again.unionByName(once), size, gram))
    single, chains = texts.where("counted"), texts.where("NOT counted")
    counted = window_rows(single, size).groupBy("h", "k").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 AND least = 1").select("h", "k")
    lone = window_rows(single.where("n = 1"), size).join(counted, ["h", "k"]).groupBy("u", "v").agg(F.sort_array(F.collect_list("at")).alias("places"))  # a unit has size - gram + 1 windows at most
    runs = saved(run_rows(single.where("n = 1").drop("at").join(lone, ["u", "v"]), size))
    distinct = runs.groupBy("u", "v").agg(F.first("words").cast("int").alias("n"), F.first("text").alias("text"))
    passages = chains.select("u", "v", "at", "words", "text").unionByName(distinct.select("u", "v", F.array(F.lit(0)).alias("at"), F.array("n").alias("words"), "text"))
    members = chains.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.explode(F.arrays_zip("us", "vs")).alias("x")).select("cu", "cv", F.col("x.us").alias("u"), F.col("x.vs").alias("v"))
    places = judged.where("n > 1").select("p", "u", "v").join(members, ["u", "v"]).select("p", F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    return passages, places.unionByName(runs.select("p", "u", "v").distinct())


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, shard_words: int = SHARD_WORDS, keep_text: bool = False) -> DataFrame:
    """The rows of docs (other columns as they are) with n_words, n_removed and kept, and with `text` too if keep_text.

    kept: the words that are left, joined by single spaces. A null text has no words and an empty
    `kept`. Equal rows repeat each other. Ids are not read: rows with a null, a repeated or a
    non-numeric id are rows like others. Columns of docs named like the new ones are replaced. No rows
    give no rows.
    """
    ship(docs.sparkSession)
    buckets = max(1, -(-text_bytes(docs, text) // bucket_bytes))
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept")]
    named = {c: f"c{i}" for i, c in enumerate(others)}
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    # Rows are dealt to buckets by number; what is written out fixes the dealing.
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).alias("p"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(x) for c, x in named.items()))
    packed = saved(packed_rows(rows, "p long, packed binary, bytes long" + "".join(f", {x} {kinds[c]}" for c, x in named.items()), list(named.values())))
    passages, places = confirmed_passages(packed, size, gram)
    sent = places.join(passages, ["u", "v"]).select("p", "at", "words", "text")

    def strip(texts: pa.Table, passages: pa.Table) -> pa.Table:
        give_back()
        words = [w for _, _, w in _texts(texts)]
        none = np.zeros(0, np.int64)
        n_words, n_removed, kept = [none], [none], []
        for w, gone in zip(words, locate(words, passages, shard_words, size)):
            total = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(w.counts)
            n_removed.append(total[w.first[1:]] - total[w.first[:-1]])
            kept.append(w.joined_words(np.flatnonzero(~gone), w.counts - n_removed[-1]))
        whole = {"text": pa.chunked_array([w.texts() for w in words], pa.string())} if keep_text else {}
        return pa.table({**{x: texts.column(x) for x in named.values()}, **whole, "n_words": np.concatenate(n_words), "n_removed": np.concatenate(n_removed), "kept": pa.chunked_array(kept, pa.string())})

    schema = ", ".join([*(f"{x} {kinds[c]}" for c, x in named.items()), *["text string"] * keep_text, "n_words long", "n_removed long", "kept string"])
    out = packed.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(strip, schema)
    return out.select(*(F.col(x).alias(c) for c, x in named.items()), *[F.col("text").alias(text)] * keep_text, "n_words", "n_removed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM d, unnest(generate_series(1, len(w) - 34)) AS t(s) WHERE len(w) >= 35),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, p FROM x JOIN r USING (h), unnest(generate_series(s, s + 34)) AS t(p)),
k AS (
  SELECT d.doc_id, u.i, d.w[u.i] AS word, c.p IS NOT NULL AS gone
  FROM d, unnest(generate_series(1, len(w))) AS u(i) LEFT JOIN c ON c.doc_id = d.doc_id AND c.p = u.i),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
