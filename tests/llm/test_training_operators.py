"""Each operator against a plain version of itself, and on rows that are null, empty, equal or long."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bytetext, chat_format, class_lm, decontaminate, embedding_dedup, language_id, licenses, minhash, pieces, quality, substring_dedup
from tallyforge.operators.graph import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def words(text):
    return SPACED.findall((text or "").translate(ASCII))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd_columns(df):
    """Extra columns with names that operators use themselves."""
    return df.withColumns({"score": F.lit("x"), "n": F.lit(None).cast("int"), "rep": F.lit(1), "key": F.lit("k"), "component": F.lit(0), "p": F.lit("p"), "h": F.lit(2)})


def vocabulary(rng, n=60):
    return ["".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(1, 6))) for _ in range(n)]


# Words and hashes


def test_words_of_texts_do_not_touch():
    texts = ["ab cd", "", None, "ef", "  x\ty\n", "gh"]
    raw, off = bytetext.text_buffer(pa.array(texts, pa.string()))
    w = bytetext.Words(raw, off)
    got = [[w.word_bytes(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [["ab", "cd"], [], [], ["ef"], ["x", "y"], ["gh"]]


def test_gram_hash_depends_on_words_alone():
    raw, off = bytetext.text_buffer(pa.array(["a b c d", "zz a  b\tc"], pa.string()))
    w = bytetext.Words(raw, off)
    at, h = w.grams(3)
    assert at.tolist() == [0, 1, 4, 5] and h[0] == h[3] and len(set(h.tolist())) == 3


def test_blocks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 0, 7, 7, 7)])], ["text"])
    assert [b.num_rows for b in bytetext.blocks(iter([batch]), limit=14)] == [1, 1, 3, 1]


# Components


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{x: 100 for x in range(101, 140)}, 201: 200}
    assert components(frame(spark, [], "a long, b long")).collect() == []


# 1 Benchmark decontamination


def plain_hits(docs, items, window):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: find.findall((t or "").translate(ASCII))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            for s in range(max(1, len(w) - window + 1)):
                windows[tuple(w[s : s + window])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for s in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[s : s + n]) in windows and s + n <= len(w):
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("blocks", [10**6, 7])
def test_decontaminate_like_plain_search(spark, blocks):
    rng = random.Random(3)
    v = vocabulary(rng)
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(1, 14)))) for i in range(25)] + [(99, None), (98, "!!"), (None, "a b"), (3, "extra windows of an item")]
    docs = [(d, ", ".join(rng.choice(v) for _ in range(rng.randint(0, 40))).upper()) for d in range(40)]
    docs += [(40, "pre " + items[0][1] + "; " + items[1][1]), (41, None), (42, ""), (43, items[2][1]), (44, items[2][1]), (45, "x " * 5000 + items[3][1])]
    got = decontaminate.decontaminate(odd_columns(frame(spark, docs)), frame(spark, items, "item_id long, text string"), window=5, block_windows=blocks).collect()
    want = plain_hits(docs, items, 5)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    assert all(sum(b - a for a, b in zip(r["hits"][::2], r["hits"][1::2])) == r["n_hit"] for r in got)


def test_decontaminate_empty_tables(spark):
    none = frame(spark, [], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, [(1, "a b")]), none).select("n_hit", "n_items").collect() == [(0, 0)]
    assert decontaminate.decontaminate(frame(spark, []), none).collect() == []


def test_clean_keeps_all_columns(spark):
    docs = odd_columns(frame(spark, [(1, "one two three"), (2, "clean"), (None, None)]))
    got = decontaminate.clean(docs, frame(spark, [(1, "two three")], "item_id long, text string"))
    assert got.columns == docs.columns and sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 2]


# 2 SentencePiece

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_pieces_like_the_library(model):
    rng = random.Random(5)
    alphabet = " \t\n  abcdetheing0123é漢😀字.,;ñ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", "   ", "a" * 500, " " * 40 + "x", "the" * 300, None]
    ids, off = pieces.Encoder(model).encode(pa.array(texts, pa.string()))
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    raw, ends = pieces.Decoder(model).decode(ids, off)
    assert [raw[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [t or "" for t in texts]


def test_long_words_like_the_library(model, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 64)
    rng = random.Random(6)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000))
    code = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000))
    texts = [cjk, code, "theing" * 700, "a" * 3000, "ba" * 1000 + "漢" * 1000]
    ids, off = pieces.Encoder(model).encode(pa.array(texts))
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    raw, ends = pieces.Decoder(model).decode(ids, off)
    assert [raw[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == texts


def test_forgetting_words_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    e = pieces.Encoder(model)
    texts = pa.array(["some words here", "some other words here now"], pa.string())
    first = e.encode(texts)
    again = e.encode(texts)
    assert all((a == b).all() for a, b in zip(first, again))


def test_unigram_paths_are_the_best():
    data = bytearray(open(pieces.MODEL_PATH, "rb").read())
    at = data.rfind(b"\x12\x06tok_v0\x18\x02") + 9
    data[at] = 1
    m = pieces.PieceModel(bytes(data))
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdetheing ") for _ in range(30)) for _ in range(200)]
    ids, off = pieces.Encoder(m).encode(pa.array(texts))
    p = sentencepiece.SentencePieceProcessor()
    p.load_from_serialized_proto(bytes(data))
    total = lambda x: sum(m.score[i] for i in x)
    assert all(total(ids[a:b]) >= total(p.encode(t)) for t, a, b in zip(texts, off, off[1:]))


def test_tokenized_rows(spark, model):
    docs = frame(spark, [(1, "Hello  world"), (1, "Hello  world"), (2, None), (3, ""), (4, "a▁b"), (None, "x")])
    got = pieces.tokenized(odd_columns(docs), model, with_ids=True).collect()
    assert [r["round_trip"] for r in sorted(got, key=lambda r: r["doc_id"] or 9)] == [True, True, True, True, False, True]
    back = pieces.decode(odd_columns(pieces.encode(odd_columns(docs), model)), model)
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in back.collect())
    assert pieces.tokenized(frame(spark, []), model).collect() == []


# 3 Quality classifier


def test_pooling_reads_the_whole_text():
    net = quality.ConvNet(filters=4)
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 256, n, np.uint8).tobytes() for n in (0, 1, 4, 5, 300, 2 * quality.CHUNK + 77)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    conv = net.p["conv"]
    want = []
    for t in texts:
        b = np.concatenate([np.frombuffer(t, np.uint8), np.zeros(len(conv), np.uint8)])
        want.append(np.max([sum(conv[k][b[i + k]] for k in range(len(conv))) for i in range(len(t) + 1)], axis=0))
    np.testing.assert_allclose(net.pooled(raw, off), np.array(want), rtol=1e-4, atol=1e-4)
    best, place, _ = net.pooled(raw, off, True)
    np.testing.assert_allclose(best, np.array(want), rtol=1e-4, atol=1e-4)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op3_quality(spark, d).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([p == y for p, y in held]) > 0.9


def test_quality_scores_like_a_plain_network(spark):
    net = quality.ConvNet(filters=3, hidden=2)
    net.shift = 0.3
    texts = ["", "plain words", "é" * 900, "x" * (quality.CHUNK + 50) + "tail"]
    p = {k: v.astype(float) for k, v in net.p.items()}

    def score(text):
        b = list(text.encode()) + [0] * quality.WIDTH
        pooled = [max(sum(p["conv"][k][b[i + k]][f] for k in range(quality.WIDTH)) for i in range(len(b) - quality.WIDTH + 1)) for f in range(3)]
        x = [math.tanh(v + c) for v, c in zip(pooled, p["bias"])]
        h = [math.tanh(sum(x[f] * p["w1"][f][j] for f in range(3)) + p["b1"][j]) for j in range(2)]
        return 1 / (1 + math.exp(-(sum(h[j] * p["w2"][j] for j in range(2)) + p["b2"][0] + 0.3)))

    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.classify(frame(spark, list(enumerate(texts))), net).collect()}
    for i, t in enumerate(texts):
        want = score(t)
        assert abs(got[i][0] - want) < 1e-4 and got[i][1] == (got[i][0] >= quality.THRESHOLD)


def test_quality_learns_from_long_texts(spark):
    rows = [(i, ("good " if i % 2 else "bad!! ") * 40_000) for i in range(120)]
    docs = frame(spark, rows)
    net = quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), epochs=40)
    assert [r["predicted"] for r in quality.classify(frame(spark, rows[:20]), net).orderBy("doc_id").collect()] == [0, 1] * 10


def test_quality_edge_cases(spark):
    docs = odd_columns(frame(spark, [(1, None), (2, ""), (2, ""), (3, "é" * 40000), (None, "x")]))
    none = frame(spark, [], "doc_id long, quality int")
    got = quality.classify(docs, quality.fit(docs, none)).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 for r in got)
    one = frame(spark, [(1, 1), (2, 1), (2, None)], "doc_id long, quality int")
    assert all(0 < r["score"] < 1 for r in quality.classify(docs, quality.fit(docs, one)).collect())
    assert quality.classify(frame(spark, []), quality.ConvNet()).collect() == []


# 4 Language ID


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in language_id.op4_language_id(spark, d).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_language_many_languages_and_odd_texts(spark):
    rng = random.Random(1)
    stems = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for i in range(70)}
    rows = [(k * 100 + j, " ".join(rng.choice(w) for _ in range(20)), name) for k, (name, w) in enumerate(stems.items()) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(docs, slot_bits=16)
    assert len(m.languages) == 70 and m.mask.shape == (1 << 16, 2)
    got = language_id.identify(odd_columns(docs), m).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !! 😀"), (4, "漢"), (5, "a")])
    pred = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, m).collect()}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[4] in stems and pred[5] in stems
    assert all(r["lang_pred"] == "und" for r in language_id.identify(odd, language_id.fit(docs.where("false"))).collect())


def plain_ngrams(text):
    b = [c + 32 if 0x41 <= c < 0x5B else c for c in text.encode()]
    b = [0x20, *[c if 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in b], 0x20]
    return [tuple(b[i : i + n]) for n in language_id.SIZES for i in range(len(b) - n + 1) if 0x20 not in b[i + 1 : i + n - 1]]


def test_language_hits_like_plain_counts(spark):
    rng = random.Random(3)
    stems = {name: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(15)] for name, letters in (("aa", "abcdefg"), ("bb", "defghijé"), ("cc", "漢字仮名ab"))}
    rows = [(k * 100 + j, " ".join(rng.choice(w) for _ in range(15)), name) for k, (name, w) in enumerate(stems.items()) for j in range(20)]
    rows += [(900 + j, "long " * 30_000, "ll") for j in range(12)] + [(950, None, "aa"), (951, "x", None), (None, "y y y", "nn")]
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10**6, longest_sample=10**6, profile=10**6, slot_bits=20)
    learned = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 0 and r[1] is not None and r[2] is not None]
    count = {l: Counter(g for _, t, k in learned if k == l for g in plain_ngrams(t)) for l in ("aa", "bb", "cc", "ll")}
    assert m.languages == ["aa", "bb", "cc", "ll"] and m.prior.tolist() == [sum(k == l for _, _, k in learned) for l in m.languages]
    texts = [" ".join(rng.choice(stems[rng.choice("abc") * 2]) for _ in range(12)) + "! 1 X" for _ in range(60)] + ["", "Long LONG 漢"]
    n, hits = m.hits(*bytetext.text_buffer(pa.array(texts)))
    assert n.tolist() == [len(plain_ngrams(t)) for t in texts]
    plain = np.array([[sum(count[l][g] > 1 for g in plain_ngrams(t)) for l in m.languages] for t in texts], float)
    assert (hits >= plain).all() and (hits != plain).mean() < 0.01
    real = np.maximum(0, (hits - n[:, None] * m.false) / (1 - m.false))
    best, score = m.predict(*bytetext.text_buffer(pa.array(texts)))
    for t in range(len(texts)):
        top = max(range(4), key=lambda i: (real[t, i], m.prior[i], -i))
        assert best[t] == top and math.isclose(score[t], real[t, top] / real[t].sum() if real[t].sum() else 0.25)


def test_language_of_long_texts_alone_is_learned(spark):
    rows = [(i, ("mono lingo " if i % 2 else "andre sprog ") * 20_000, "ml" if i % 2 else "as") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs, longest_sample=1000)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


# 5 Licence scans


def plain_dice(text, templates, threshold):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: find.findall((t or "").translate(ASCII))
    pairs = lambda w: set(zip(w, w[1:]))
    w, out = cut(text), {}
    for name, t in templates.items():
        own, n = pairs(cut(t)), min(len(cut(t)), len(w))
        best = max((2 * len(own & pairs(w[s : s + n])) / (len(own) + len(pairs(w[s : s + n]))) for s in range(len(w) - n + 1) if n > 1), default=0)
        if best >= threshold:
            out[name] = round(best, 9)
    return out


def test_licenses_like_plain_dice(spark):
    rng = random.Random(4)
    t = licenses.TEMPLATES | licenses.whole_texts()
    assert {"Apache-2.0", "GPL-3.0", "MPL-2.0"} <= set(t)
    texts = [None, "", "MIT", "Released under the MIT license", "foo " * 50 + t["MIT"] + " bar" * 20, t["ISC"].upper().replace("ISC", "x"), t["Zlib"] + "\n" + t["MIT-line"], "the software is free of charge " * 40]
    for name in licenses.TEMPLATES:
        w = t[name].split()
        for i in rng.sample(range(len(w)), len(w) // 12):
            w[i] = "changed"
        texts.append("intro words " + " ".join(w) + " and an end")
    got = licenses.scan(odd_columns(frame(spark, list(enumerate(texts)))), threshold=0.7).collect()
    assert {r["doc_id"]: {m["name"]: round(m["score"], 9) for m in r["matches"]} for r in got} == {i: plain_dice(x, t, 0.7) for i, x in enumerate(texts)}
    assert licenses.scan(frame(spark, [])).collect() == []


def test_licenses_long_texts_and_ties(spark):
    t = licenses.TEMPLATES | licenses.whole_texts()
    two = {"b": "one two three four", "a": "one two three four", "c": "one two three four five"}
    docs = frame(spark, [(1, t["GPL-3.0"]), (2, "intro\n" + t["Apache-2.0"] + "\nend"), (3, "\n".join([t["MIT"]] * 300)), (4, "one two three four"), (4, "one two three four")])
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["best"] for i in (1, 2, 3)] == ["GPL-3.0", "Apache-2.0", "MIT"] and got[3]["matches"][0]["start"] == 0
    assert [m["name"] for m in licenses.scan(docs, two).where("doc_id = 4").collect()[0]["matches"]] == ["a", "b", "c"]
    assert {r["best"] for r in licenses.scan(docs, two).where("doc_id = 4").collect()} == {"a"}


# 6 Substring dedup


def plain_repeats(docs, size):
    cut = [SPACED.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[s : s + size]) for w in cut for s in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(docs, cut):
        gone = {p for s in range(len(w) - size + 1) if seen[tuple(w[s : s + size])] > 1 for p in range(s, s + size)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket,shard", [(1 << 23, 400_000), (300, 12)])
def test_repeats_like_plain_count(spark, bucket, shard):
    rng = random.Random(9)
    v = vocabulary(rng, 200)
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    shared = [text(rng.randint(4, 30)) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 12)), rng.choice(shared), text(rng.randint(0, 5)), rng.choice(shared + [""])]
        docs.append((d, "\n".join(parts)))
    edited = docs[0][1].split()
    for d in range(60, 75):
        w = list(edited)
        w[rng.randrange(len(w))] = "edit"
        docs.append((d, " ".join(w)))
    docs += [(75, "In " * 40), (76, "In " * 9), (77, None), (78, ""), (78, ""), (79, docs[5][1]), (79, docs[5][1]), (None, "a b c"), (80, " ".join(docs[7][1].split()[2:9]))]
    got = substring_dedup.remove_repeats(odd_columns(frame(spark, docs)), size=5, gram=2, bucket_bytes=bucket, shard_words=shard)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=repr) == plain_repeats(docs, 5)
    assert {"score", "rep", "p"} <= set(got.columns)


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []
    assert [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, [(1, "one two")])).collect()] == [(1, 2, 0, "one two")]


def block_of(texts):
    return bytetext.Words(*bytetext.text_buffer(pa.array(texts, pa.string())))


def chains_of(passages):
    """Each two passages as one chain."""
    two = [passages[i : i + 2] for i in range(0, len(passages), 2)]
    kind = pa.list_(pa.int32())
    return pa.table({"at": pa.array([[0, len(x[0])][: len(x)] for x in two], kind), "words": pa.array([list(map(len, x)) for x in two], kind), "text": [" ".join(" ".join(y) for y in x) for x in two]})


@pytest.mark.parametrize("shard", [9, 10**6])
def test_automata_locate_like_plain_search(shard):
    rng = random.Random(8)
    v = vocabulary(rng, 12)
    cut = [[rng.choice(v) for _ in range(rng.randint(0, 60))] for _ in range(30)]
    passages = [[rng.choice(v) for _ in range(rng.randint(3, 4))] for _ in range(150)]
    found = substring_dedup.locate([block_of([" ".join(w) for w in cut[:11]]), block_of([" ".join(w) for w in cut[11:]])], chains_of(passages), shard, 3)
    want = [any(w[s : s + len(x)] == x for x in passages for s in range(max(0, i - len(x) + 1), i + 1)) for w in cut for i in range(len(w))]
    assert np.concatenate(found).tolist() == want


def test_automata_compare_bytes_and_not_hashes(monkeypatch):
    monkeypatch.setattr(bytetext.Words, "hash", property(lambda w: np.zeros(len(w), np.uint64)))
    found = substring_dedup.locate([block_of(["x a b c x", "a b d", "ab c"])], chains_of([["a", "b", "c"], ["a", "b", "b", "d"]]), 10**6, 3)
    assert found[0].tolist() == [False, True, True, True, False] + [False] * 5


def test_automata_alone_decide(spark, monkeypatch):
    docs = frame(spark, [(i, "one two three four five six") for i in range(3)])
    packed = substring_dedup.saved(substring_dedup.packed_rows(docs.select(F.lit(0).cast("long").alias("p"), "text"), "p long, packed binary, bytes long", []))
    passages, places = substring_dedup.confirmed_passages(packed, 5, 2)
    assert passages.count() == places.count() == 1 and passages.first()["text"] == "one two three four five six"
    monkeypatch.setattr(substring_dedup, "confirmed_passages", lambda *_: (passages, places.where("false")))
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(docs, size=5, gram=2).collect()} == {0}


def test_repeats_of_rows_without_ids_and_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = frame(spark, [(None, "a b c d e f")] * 40 + [(7, "a b c d e f g")] * 3 + [(8, long), (8, long + " end")])
    got = substring_dedup.remove_repeats(docs, size=5, gram=2, bucket_bytes=100)
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == [(0, 6, 6, "")] * 40 + [(7, 7, 7, "")] * 3 + [(8, 60_000, 60_000, ""), (8, 60_001, 60_000, "end")]


# 7 Embedding near-dedup


def plain_links(rows, threshold):
    ok = {}
    for i, (k, v) in enumerate(rows):
        x = None if v is None or None in v else np.array(v, np.float64)
        if k is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = x / np.linalg.norm(x)
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    n = Counter()
    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= threshold:
                n[i] += 1
                n[j] += 1
                top[root(j)] = root(i)
    small = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        small[root(i)].append(k)
    return sorted(((k, n[i], k if k is None else min(x for x in small[root(i)] if x is not None)) for i, (k, _) in enumerate(rows)), key=repr)


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [[float(x) for x in rng.normal(size=16)] for _ in range(150)]
    for base, many, noise in ((0, 40, 0.03), (1, 12, 0.08), (2, 3, 0.05)):
        rows += [[float(x) for x in np.array(rows[base]) + rng.normal(size=16) * noise] for _ in range(many)]
    rows += [rows[5]] * 30 + [[x * 7 for x in rows[5]]] + [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [1.0, 0.01], [1e30] * 16, [1e-30] * 16]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), v) for i, v in enumerate(rows)] + [(None, rows[5]), (11, rows[0]), (11, [1.0] * 5000), (12, [1.0] * 5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_vectors(odd_columns(df)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == plain_links(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_vectors(df.where("false")).collect() == []


def test_vectors_of_other_number_types(spark):
    rows = [(1, [100_000_001, 1]), (2, [100_000_001, 1]), (3, [1, 100_000_001]), (4, None), (5, [0, 0])]
    for kind in ("int", "long", "decimal(12,2)"):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<long>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_audit_measures_what_is_missing(spark):
    rows = [(i, [1.0, i / 1e4]) for i in range(20)] + [(20, [-1.0, 1.0])]
    vectors = spark.createDataFrame([(i, 2, np.array(v).tobytes(), 1) for i, v in rows], "rep long, dim int, vec binary, size long")
    found = lambda n: spark.createDataFrame([(i, n) for i in range(20)], "rep long, links long")
    of = lambda v, n: embedding_dedup.audit(embedding_dedup.sampled(v, 21), v, found(n), "<f8", 0.95)
    assert of(vectors, 19) == 1 and abs(of(vectors, 10) - 10 / 19) < 1e-9 and math.isnan(of(vectors.where("rep > 18"), 0))


def test_links_are_counted_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, [float(x) for x in base + rng.normal(size=8) * 0.02]) for i in range(40)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == plain_links(rows, 0.95)


# 8 Language-model scoring


def test_links_between_clusters_longer_than_a_list(spark):
    rng = np.random.default_rng(4)
    first, second = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    centres = [first, 0.965 * first + np.sqrt(1 - 0.965**2) * second]
    x = np.concatenate([c + rng.normal(size=(200, 64)) * 0.1 / 8 for c in centres]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    across = s[:200, 200:]
    assert min(s[:200, :200].min(), s[200:, 200:].min()) > across.max() and (across >= 0.95).sum() > 10_000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (int(n) - 1, 0, i == 0) for i, n in enumerate((s >= 0.95).sum(axis=1))}


def plain_base(docs):
    training = Counter()
    for d, t in docs:
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            training.update([*words(t), ("end",)])
    n, v = sum(training.values()), len(training)
    return [(d, len(k), sum(training[w] > 0 for w in k), n, sum(math.log10((training[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k)) for d, t in docs for k in [[*words(t), ("end",)]]]


def some_texts(rng):
    v = vocabulary(rng, 150)
    docs = [(d, " ".join(rng.choice(v[: 10 + d % 140]) for _ in range(rng.randint(0, 50)))) for d in range(80)]
    return docs + [(80, None), (81, ""), (82, "Unseen WORDS only"), (5, "a b"), (None, "a b"), (83, "longer " * 30_000 + "tail")]


def fitted(spark, df, **bounds):
    class_lm.ship(spark)
    training = df.where(class_lm.fold("doc_id") != 1).select("text")
    counts = class_lm.saved(class_lm.word_counts(training))
    return counts, class_lm.fit(training, counts, **bounds)


@pytest.mark.parametrize("common,core", [(10**6, 50), (40, 20), (0, 0)])
def test_language_model_counts(spark, common, core):
    docs = some_texts(random.Random(6))
    df = frame(spark, docs)
    got = class_lm.score_texts(odd_columns(df), *fitted(spark, df, common=common, core=core)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 9))
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(mine, sorted(plain_base(docs), key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)
    assert all(r["score"] < 0 for r in got)


def plain_classes(docs, model):
    """Each training word's class, from the model; and the class of any other word's form."""
    hashes = {}
    for _, t in docs:
        b = bytetext.Words(*bytetext.text_buffer(pa.array([(t or "")], pa.string())), lower=True)
        hashes.update({b.word_bytes(i).decode(): (int(b.hash[i]), int(x)) for i, x in enumerate(class_lm.shape(b))})
    of = dict(zip(model.v.hash.tolist(), model.v.group.tolist()))
    return {w: (of.get(h, -1) if of.get(h, -1) >= 0 else class_lm.CLASSES + x) for w, (h, x) in hashes.items()}


@pytest.mark.parametrize("common", [10**6, 60])
def test_language_model_scores_like_a_plain_model(spark, common):
    docs = some_texts(random.Random(7))
    df = frame(spark, docs)
    counts, m = fitted(spark, df, common=common, core=15)
    group = plain_classes(docs, m)
    end = class_lm.CLASSES + class_lm.SHAPES
    training = [words(t) for d, t in docs if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    count = Counter(w for t in training for w in t)
    assert {group[w] < class_lm.CLASSES for w in count if count[w] > 1} == ({True} if common > 1000 else {True, False})
    assert all(group[w] >= class_lm.CLASSES for w in count if count[w] == 1)
    line = lambda t: [group[w] for w in t] + [end]
    after = Counter(pair for t in training for pair in zip([end, *line(t)], line(t)))
    size, out = Counter(), Counter()
    for (a, b), n in after.items():
        out[a] += n
        size[b] += n
    prior = {k: size[k] + 0.5 for k in range(end + 1)}
    types, tokens = Counter(group[w] for w in count), Counter()
    for w, n in count.items():
        tokens[group[w]] += n

    def word(w):
        k = group[w]
        return count[w] / size[k] if k < class_lm.CLASSES else (count[w] + 0.5) / (tokens[k] + 0.5 * (types[k] + 1))

    def score(t):
        total = 0.0
        for a, b, w in zip([end, *line(t)], line(t), [*t, None]):
            total += math.log10((after[a, b] + class_lm.PULL * prior[b] / sum(prior.values())) / (out[a] + class_lm.PULL))
            total += math.log10(word(w)) if w is not None else 0.0
        return total

    got = sorted((r["doc_id"] or -1, r["score"]) for r in class_lm.score_texts(df, counts, m).collect())
    want = sorted((d or -1 if d != 0 else -1, score(words(t))) for d, t in docs)
    assert [a for a, _ in got] == [a for a, _ in want]
    np.testing.assert_allclose([b for _, b in got], [b for _, b in want], rtol=1e-9)


def test_words_join_the_class_that_raises_the_likelihood_most():
    rng = np.random.default_rng(3)
    groups = class_lm.CLASSES + 5
    table = rng.integers(0, 40, (groups, groups)).astype(float)
    rows = [(p, int(c), int(rng.integers(1, 6))) for p in (3, 8, 9) for c in rng.choice(2 * groups, 6, replace=False)]
    rows += [(p, groups - 1 if sum(n for q, c, n in rows if q == p and c < groups) else 0, 1) for p in (3,)]
    place, cell, n = (np.array(x) for x in zip(*sorted(rows)))
    got = dict(zip(*(x.tolist() for x in class_lm.best_classes(place, cell, n, table))))
    g = lambda x: x * np.log(np.maximum(x, 1))
    for p in (3, 8, 9):
        own = np.zeros((2, groups))
        for q, c, k in rows:
            if q == p:
                own[c // groups, c % groups] += k
        gains = []
        for k in range(class_lm.CLASSES):
            gain = (g(table[:, k] + own[0]) - g(table[:, k])).sum() + (g(table[k] + own[1]) - g(table[k])).sum()
            gains.append(gain - 2 * (g(table[k].sum() + own[0].sum()) - g(table[k].sum())))
        assert got[p] == int(np.argmax(gains))


def test_class_probabilities_sum_to_one(spark):
    docs = [(d, t) for d, t in some_texts(random.Random(1)) if d != 83]
    counts, m = fitted(spark, frame(spark, docs), core=15)
    np.testing.assert_allclose((10.0**m.step).sum(axis=1), 1)
    inside = m.v.group >= 0
    for k in set(m.v.group[inside].tolist()):
        assert math.isclose((m.v.count[m.v.group == k] * 10.0 ** m.emit[k]).sum(), 1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    clustered, side = 24, 24 + 3
    group = np.arange(side) % 3
    b = rng.poisson(np.where(group[:, None] == (group[None] + 1) % 3, 20, 0.5)).astype(float)
    label = class_lm.exchange(b, clustered, classes=3)

    def bits(l):
        one = np.eye(l.max() + 1)[l]
        n = one.T @ b @ one
        g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return g(n) - g(n.sum(0)) - g(n.sum(1))

    start = np.concatenate([np.arange(clustered) * 7 % 5 % 3, [3, 4, 5]])
    assert bits(label) >= bits(start) and len({tuple(sorted(group[:clustered][label[:clustered] == k])) for k in range(3)}) == 3


def test_language_model_of_nothing(spark):
    assert class_lm.score_documents(frame(spark, [])).collect() == []
    only = [d for d in range(99) if zlib.crc32(str(d).encode()) % 5 == 1][0]
    r = class_lm.score_documents(frame(spark, [(only, "a b")])).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["held_out"]


# 9 Chat formatting


def test_chat_round_trip(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\", "\\\\<|next|>\\", "a<", "|end|>", "<|", "line\nline", "é😀", "$1 \\1", "[[INST]", "<<s>"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole\\"]), rng.choice(odd)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(50, 1, "user", "b"), (50, 1, "assistant", "a"), (50, 1, "user", "b"), (51, None, "user", "first"), (51, 0, "user", "then"), (None, 0, "assistant", "x"), (52, 0, "assistant", "y " * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(odd_columns(df)).select("conv_id", "formatted", "segments", chat_format.read_back(F.col("formatted")).alias("turns")).collect()
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == {c: [x[2:] for x in sorted(v)] for c, v in want.items()}
    for r in out:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        loss = [re.sub(r"(?s)\\(.)", r"\1", s["text"]) for s in r["segments"] if s["loss"]]
        assert loss == [x[3] for x in sorted(want[r["conv_id"]]) if x[2] == "assistant"]
    # One header for each run of turns of one role.
    for r in out:
        roles = [x[2] for x in sorted(want[r["conv_id"]])]
        assert r["formatted"].count("<|turn|>") == 1 + sum(a != b for a, b in zip(roles, roles[1:]))
    assert chat_format.format_conversations(df.where("false")).collect() == []


def test_chat_formatting_is_native(spark):
    plan = chat_format.op9_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10 MinHash near-dedup


def plain_groups(docs):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                top[root(i)] = root(j)
    small = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        small[root(i)].append(d)
    return sorted(((d, len(sets[i]), d if d is None else min(x for x in small[root(i)] if x is not None)) for i, (d, _) in enumerate(docs)), key=repr)


@pytest.mark.parametrize("block", [minhash.BLOCK, 5])
def test_near_duplicates_like_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    v = vocabulary(rng, 400)
    docs = []
    for g in range(25):
        base = [rng.choice(v) for _ in range(rng.choice([1, 3, 5, 6, 12, 40, 150, 600]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(v)
            docs.append(" ".join(w) if rng.random() < 0.7 else "  ".join(w).upper())
    line = " ".join(rng.choice(v) for _ in range(30))
    docs += [line + " " + " ".join(rng.choice(v) for _ in range(25)) for _ in range(40)]
    docs += [None, "", "  ", docs[0], docs[0]]
    rng.shuffle(docs)
    long = [f"w{rng.randrange(9000)}" for _ in range(30_000)]
    docs = list(enumerate(docs)) + [(3, "a text with an id of another"), (5, docs[7]), (6, docs[9] + " x"), (None, docs[0]), (900, " ".join(long)), (901, " ".join(long[:29_000]))]
    got = minhash.near_duplicates(odd_columns(frame(spark, docs))).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == plain_groups(docs)
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_chance_correction_matches_simulation():
    rng = np.random.default_rng(5)
    for n in (50, 2000):
        h = rng.integers(0, 1 << 63, 400 * n, dtype=np.uint64)
        regs = minhash.sketches(h, np.arange(0, 400 * n + 1, n))
        seen = (regs[:200] == regs[200:]).mean()
        p = minhash.by_chance(np.array([float(n)]), np.array([float(n)]))[0]
        assert seen < 3 * p + 0.002


