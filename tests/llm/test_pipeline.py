"""The pipeline against plain versions of its stages, one after the other."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_training_operators import plain_groups, plain_hits, plain_repeats, sentencepiece  # noqa: E402

import corpus_pipeline
from tallyforge.llm import pieces

DIR = "/root/testdata/sf0.001"


def test_pipeline_like_plain_stages(spark):
    got = corpus_pipeline.run(spark, DIR).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    kept = {d for d, _, c in plain_groups(docs) if d == c}
    docs = [(d, t) for d, t in docs if d in kept]
    stripped = {d: (n, gone, left) for d, n, gone, left in plain_repeats(docs, 35)}
    docs = [(d, stripped[d][2] if stripped[d][1] else t) for d, t in docs if stripped[d][0] > stripped[d][1]]
    hits = plain_hits(docs, items, 10)
    docs = [(d, t) for d, t in docs if not hits[d][1]]
    ids = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).encode([t for _, t in docs])
    assert {r["doc_id"]: r["ids"] for r in got} == {d: x for (d, _), x in zip(docs, ids)} and len(got) == len(docs)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_keep_the_columns_of_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "just one text with letters", "en", "s", 26), (None, "another text without any id", "de", "s", 27)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == odd.columns, name
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == [(0, "another text without any id"), (3, "just one text with letters")]
    empty = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).collect() == []
    assert all(re.fullmatch(r"[\w -]+", name) for name, _ in corpus_pipeline.STAGES)


def test_rows_delivered_twice_or_without_an_id_stay_once(spark):
    clean = {name: " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) for name in ("again", "none", "shared", "other", "alone")}
    rows = [(1, clean["again"]), (1, clean["again"]), (None, clean["none"]), (None, clean["none"]), (7, clean["shared"]), (None, clean["shared"]), (9, clean["other"]), (9, clean["alone"]), (5, clean["other"])]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, DIR))
        assert docs.columns == odd.columns, name
        assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == sorted([(1, clean["again"]), (0, clean["none"]), (7, clean["shared"]), (5, clean["other"]), (9, clean["alone"])]), name
