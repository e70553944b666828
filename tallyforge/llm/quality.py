"""Quality classifier: a byte-level convolutional network in numpy.

A filter of WIDTH bytes is a table of weights for each byte at each place. Its response is taken at
every byte of the text, in chunks of CHUNK positions that overlap by WIDTH - 1 bytes, so nothing of
a document is left out. Each filter's largest response over the document (max pooling) goes through
a hidden layer to one probability.

Fitting runs on the driver, on a hash sample of about `per_class` labelled texts of each class. Of a
sampled text that has more than `longest_sample` characters so many are taken, from a place that a
hash of the id gives, so that texts of every length are learned from; the output bias is then moved to the classes' true shares. Scoring
is one pass over whole texts with a model of a few dozen KB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import ranges, text_buffer
from tallyforge.llm.common import documents, fold, map_blocks, piece

WIDTH = 5
FILTERS = 16
HIDDEN = 8
CHUNK = 1 << 15
PER_CLASS = 2000
LONGEST_SAMPLE = 16 << 10
EPOCHS = 12
THRESHOLD = 0.3


class ConvNet:
    def __init__(self, seed: int = 7, width: int = WIDTH, filters: int = FILTERS, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.p = {
            "conv": rng.normal(0, 0.3, (width, 256, filters)).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "w1": rng.normal(0, 1 / np.sqrt(filters), (filters, hidden)).astype(np.float32),
            "b1": np.zeros(hidden, np.float32),
            "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def pooled(self, raw: np.ndarray, off: np.ndarray, where: bool = False):
        """Largest response of each filter over each text; with `where`, also its place in the padded bytes."""
        conv = self.p["conv"]
        width, _, filters = conv.shape
        n = len(off) - 1
        # Each text is followed by `width` zero bytes, so no response reaches the next; an empty text has one response.
        count = np.diff(off) + 1
        first = np.concatenate([[0], np.cumsum(count + width - 1)])
        buf = np.zeros(first[-1], np.uint8)
        buf[ranges(first[:-1], np.diff(off))] = raw
        best = np.full((n, filters), -np.inf, np.float32)
        place = np.zeros((n, filters), np.int64)
        for a in range(0, len(buf) - width + 1, CHUNK):
            b = min(a + CHUNK, len(buf) - width + 1)
            out = conv[0][buf[a:b]]
            for k in range(1, width):
                out += conv[k][buf[a + k : b + k]]
            t0, t1 = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
            for_texts = np.arange(t0, t1)
            lo, hi = np.maximum(first[for_texts], a), np.minimum(first[for_texts] + count[for_texts], b)
            some = hi > lo
            for_texts, lo, hi = for_texts[some], lo[some], hi[some]
            if where:
                for t, x, y in zip(for_texts, lo, hi):
                    part = out[x - a : y - a]
                    arg = part.argmax(axis=0)
                    top = part[arg, np.arange(filters)]
                    more = top > best[t]
                    best[t, more], place[t, more] = top[more], arg[more] + x
            else:
                if not len(lo):
                    continue
                # Positions that lie over padding belong to no text.
                edges = np.stack([lo - a, np.minimum(hi - a, len(out) - 1)], 1).reshape(-1)
                if hi[-1] - a == len(out):
                    edges = edges[:-1]
                best[for_texts] = np.maximum(best[for_texts], np.maximum.reduceat(out, edges, axis=0)[::2])
        return (best, place, buf) if where else best

    def head(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        x = np.tanh(best + p["bias"])
        h = np.tanh(x @ p["w1"] + p["b1"])
        return x, h, h @ p["w2"] + p["b2"][0]

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.head(self.pooled(raw, off))[2].astype(float) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, batch: int = 32, rate: float = 0.02) -> None:
        """Adam on the log loss, both classes weighing the same."""
        rng = np.random.default_rng(seed)
        labels = np.asarray(labels, np.float32)
        share = max(1e-6, float(labels.mean()))
        weight = np.where(labels > 0, 0.5 / share, 0.5 / max(1e-6, 1 - share)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        width = len(self.p["conv"])
        step = 0
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                raw = np.frombuffer(b"".join(texts[j] for j in pick), np.uint8)
                off = np.concatenate([[0], np.cumsum([len(texts[j]) for j in pick])])
                best, place, buf = self.pooled(raw, off, True)
                x, h, z = self.head(best)
                dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) * weight[pick] / len(pick)
                dh = np.outer(dz, self.p["w2"]) * (1 - h * h)
                dx = dh @ self.p["w1"].T * (1 - x * x)
                g = {"w2": h.T @ dz, "b2": np.array([dz.sum()]), "w1": x.T @ dh, "b1": dh.sum(0), "bias": dx.sum(0), "conv": np.zeros_like(self.p["conv"])}
                f = np.arange(dx.shape[1])
                for k in range(width):
                    np.add.at(g["conv"][k], (buf[place + k], np.broadcast_to(f, place.shape)), dx)
                step += 1
                now = rate * (1 - step / (total + 1))
                for key, grad in g.items():
                    grad = grad + 1e-4 * self.p[key]
                    m[key] = 0.9 * m[key] + 0.1 * grad
                    v[key] = 0.999 * v[key] + 0.001 * grad * grad
                    self.p[key] = (self.p[key] - now * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, longest_sample: int = LONGEST_SAMPLE, epochs: int = EPOCHS) -> ConvNet:
    """A network fitted to labels 0 and 1; rows of fold 0, null labels and null texts are not used.

    Repeated rows are learned from as often as they occur. Without both classes, or from empty tables,
    it scores 1/2 or the one class's share.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold(doc_id) != 0)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    scale = 1 << 30
    rate = F.when(F.col("y") == 1, min(scale, scale * per_class // max(1, counts.get(1, 0)))).otherwise(min(scale, scale * per_class // max(1, counts.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(scale)) < rate)  # about 2 * per_class rows
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id").select("id", "y", piece("text", "id", longest_sample).alias("text"))
    got = sorted((r["id"], r["y"], r["text"]) for r in rows.toLocalIterator())
    net = ConvNet()
    y = np.array([r[1] for r in got], float)
    true = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(got) and 0 < y.mean() < 1:
        net.train([r[2].encode() for r in got], y, epochs)
    else:
        net.p["w2"][:] = 0
    net.shift = float(np.log(true / (1 - true))) if counts else 0.0
    return net


def classify(docs: DataFrame, net: ConvNet, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row.

    A null text is an empty one, and an empty one has a score. Equal rows score alike, each by itself;
    no rows give no rows. Ids are integers or cast to them. Only the two named columns are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = sent.value.score(*text_buffer(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_blocks(rows, "doc_id long, score double, predicted int", each)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")
