"""Language identification with language-bitmask n-gram filters.

Training. Labelled texts give, for each language, its most frequent byte n-grams (3 to 5 bytes of
lower-cased words, with the spaces around them). A Bloom filter of each language is kept bit-sliced:
slot s of one shared table is a bitmask over languages, so k look-ups and an AND return every
language that holds an n-gram.

Prediction. Over the whole text, each language's hits are counted and corrected for the filter's
false positives: (hits - n * p) / (1 - p), where p is the share of slots with the language's bit to
the power k. The largest corrected count decides.

Bounds. Fitting reads a hash sample of about `per_language` labelled texts of each language, and of
one that has more than `longest_sample` characters so many, from a place that a hash of the id gives;
so a language whose texts are all long is learned too. The model has 2**slot_bits slots. Scoring has
no bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import ASCII_LOWER, U64, mix, signed, text_buffer, unsigned
from tallyforge.llm.common import documents, fold, map_blocks, piece

SIZES = (3, 4, 5)
PER_LANGUAGE = 400
LONGEST_SAMPLE = 64 << 10
PROFILE = 3000
SLOT_BITS = 18
PROBES = 3
UNDETERMINED = "und"
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_TABLES = mix(np.arange(1, 256 * max(SIZES) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(max(SIZES), 256)


def ngrams(raw: np.ndarray, off: np.ndarray):
    """For each size: the byte n-grams' hashes and the offsets of those of each text.

    A text is taken with a space before and after it; all but letters and non-ASCII bytes count as
    one space each. An n-gram may begin or end with a space but has none inside.
    """
    n = len(off) - 1
    size = np.diff(off) + 2
    first = np.concatenate([[0], np.cumsum(size)])
    buf = np.full(first[-1], 0x20, np.uint8)
    low = ASCII_LOWER[raw]
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    buf[at] = np.where(_LETTER[low], low, 0x20)
    letter = buf != 0x20
    total = len(buf)
    h = _TABLES[0][buf]
    inner = np.ones(total, bool)  # bytes 1 .. k - 2 from here are letters
    for k in range(1, max(SIZES)):
        h = h[:-1] + _TABLES[k][buf[k:]]
        inner = inner[:-1] if k == 1 else inner[:-1] & letter[k - 1 : -1]
        if k + 1 in SIZES:
            good = np.flatnonzero(inner)
            yield mix(h[good]), np.searchsorted(good, first)


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int, longest: int) -> DataFrame:
    """(lang, text) of about per_language labelled training texts of each language, chosen by a hash of the id; pieces of those longer than `longest`."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id) != 0)).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = known.withColumn("text", piece("text", "id", longest))
    counts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id) != 0)).groupBy(F.col(lang).alias("lang")).count()
    scale = 1 << 30
    rates = {r["lang"]: min(scale, scale * per_language // r["count"]) for r in counts.toLocalIterator()}
    if not rates:
        return known.select("lang", "text")
    rate = F.create_map(*[F.lit(x) for kv in sorted(rates.items()) for x in kv])
    return known.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(scale)) < rate[F.col("lang")]).select("lang", "text")


class LanguageModel:
    """languages in order; mask: (slots, words) of 64-bit language bitmasks; prior: sampled texts of each."""

    def __init__(self, languages: list[str], prior: list[int], grams: list[tuple[int, int]], slot_bits: int, probes: int):
        self.languages, self.prior, self.bits, self.probes = languages, np.asarray(prior, float), slot_bits, probes
        self.mask = np.zeros((1 << slot_bits, -(-len(languages) // 64) or 1), U64)
        for number in range(len(languages)):
            h = unsigned(np.array([g for l, g in grams if l == number], np.int64))
            for slot in self.slots(h):
                self.mask[slot, number // 64] |= U64(1 << number % 64)
        held = [(self.mask[:, i // 64] >> U64(i % 64)) & U64(1) for i in range(len(languages))]
        self.false = np.array([float(x.mean()) ** probes for x in held])

    def slots(self, h: np.ndarray):
        for k in range(self.probes):
            yield ((h >> U64(k * 20)) & U64((1 << self.bits) - 1)).astype(np.int64)

    def hits(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and those held by each language."""
        n = np.zeros(len(off) - 1)
        out = np.zeros((len(off) - 1, len(self.languages)))
        for h, first in ngrams(raw, off):
            n += np.diff(first)
            held = None
            for slot in self.slots(h):
                own = self.mask[slot]
                held = own if held is None else held & own
            for i in range(len(self.languages)):
                total = np.concatenate([[0], np.cumsum((held[:, i // 64] >> U64(i % 64)) & U64(1))]).astype(float)
                out[:, i] += total[first[1:]] - total[first[:-1]]
        return n, out

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text, and a score from 0 to 1."""
        n, hits = self.hits(raw, off)
        real = np.maximum(0, (hits - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)))
        order = np.lexsort((np.arange(len(self.languages)), -self.prior))  # ties: more frequent, then first by name
        best = order[np.argmax(real[:, order], axis=1)]
        total = real.sum(axis=1)
        score = np.where(total > 0, real[np.arange(len(real)), best] / np.where(total > 0, total, 1), 1 / len(self.languages))
        return best, score


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, longest_sample: int = LONGEST_SAMPLE, profile: int = PROFILE, slot_bits: int = SLOT_BITS, probes: int = PROBES) -> LanguageModel:
    """A model of the languages that training rows are labelled with; rows of fold 0 are not read."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        names = np.array(batch.column(0).to_pylist(), object)
        out = []
        for name in sorted(set(names)):
            part = batch.filter(pa.array(names == name))
            grams = np.concatenate([h for h, _ in ngrams(*text_buffer(part.column(1)))])
            h, n = np.unique(grams, return_counts=True)
            out.append(pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(signed(h)), pa.array(n.astype(np.int64))], ["lang", "h", "n"]))
        return next(iter(pa.Table.from_batches(out).combine_chunks().to_batches()), None)  # none if no text has an n-gram

    rows = sample(docs, doc_id, text, lang, per_language, longest_sample)
    counted = map_blocks(rows, "lang string, h long, n long", each).groupBy("lang", "h").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).where(F.col("r") <= profile)
    prior = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(prior)
    number = {l: i for i, l in enumerate(languages)}
    grams = [(number[r["lang"]], r["h"]) for r in top.select("lang", "h").toLocalIterator()]
    return LanguageModel(languages, [prior[l] for l in languages], grams, slot_bits, probes)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    raw, off = text_buffer(column)
    low = ASCII_LOWER[raw]
    total = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode())
    return out


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out_lang: str = "lang_pred", out_score: str = "score") -> DataFrame:
    """docs with a predicted language and its score, for whole texts and without a shuffle.

    A text that is null or has no letter is `und` with score 0, and so is every text if no language
    was learned. Equal rows are judged alike, each by itself; no rows give no rows. Of languages with
    equally many n-grams the one with more training texts wins, then the first by name. Columns of docs
    named like the two new ones are replaced; all others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (out_lang, out_score)]
    docs = docs.select(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out_lang}` string", f"`{out_score}` double"])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m: LanguageModel = sent.value
        column = batch.column(keep.index(text))
        letters = has_letter(column)
        if m.languages:
            best, score = m.predict(*text_buffer(column))
            names = np.array([*m.languages, UNDETERMINED], object)[np.where(letters, best, -1)]
            score = np.where(letters, score, 0.0)
        else:
            names, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(names), pa.string()), pa.array(score)], [*keep, out_lang, out_score])

    return map_blocks(docs, schema, each, text)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
