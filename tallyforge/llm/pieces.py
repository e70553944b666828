"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Words (spaces as U+2581 and what follows them, cut wherever two characters meet that no piece has
side by side) of one length advance together. The hashes of all
their substrings of up to the longest piece's length probe the sorted hashes of the pieces; then,
place by place, the best piece that ends there is chosen for all words at once and its length kept as
a backpointer.

Unigram models: the best path has the largest sum of piece scores. Merge (BPE) models: a word's
pieces are those of the merge procedure exactly if every piece comes out of its own characters, and
each two neighbours stay two pieces when merged by themselves. A prefix of such a path is such a path,
so one survivor for each place is enough here too: the piece whose join with the survivor before it
is stable. Stability of a pair is decided by undoing its two pieces' last merges, latest first, and
asking whether a join across the border would have come earlier.

Characters without a piece become their UTF-8 bytes' pieces. Models that change texts other than by
turning spaces into U+2581 and putting one in front are refused.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import U64, _power, mix, ranges, text_buffer
from tallyforge.llm.common import documents, map_blocks, ship

#: Where the vocabulary file is; it is read on the driver alone.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
NEVER = 1 << 40
#: Below the smallest score: a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Cells (words times characters) searched at once, words remembered by a task, slots for pairs.
CELLS = 1 << 18
#: Places of a word whose pieces are looked up at once.
WINDOW = 1 << 12
REMEMBERED = 400_000
PAIR_SLOTS = 1 << 21


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            value, at = data[at : at + 4], at + 4
        yield key >> 3, value


def code_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums that give the hash of any run of characters."""
    up, down = _power("bytes", len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return total, down


def run_hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U64))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(U64) << U64(21)) | b.astype(U64)


def _slot(key: np.ndarray) -> np.ndarray:
    return (mix(key) & U64((1 << 20) - 1)).astype(np.int64)


class PieceModel:
    """A vocabulary as arrays; `kind` is UNIGRAM or MERGES."""

    def __init__(self, data: bytes):
        pieces, self.kind, prefix, extra, chars_map, byte_fallback = [], UNIGRAM, True, True, b"", False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                chars_map, prefix, extra = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (UNIGRAM, MERGES) or chars_map or extra or not prefix or not byte_fallback:
            raise ValueError("only unigram and merge models with byte pieces and unchanged texts are supported")
        self.pieces = pieces
        self.size = len(pieces)
        self.bytes = np.array([next(i for i, (p, _, t) in enumerate(pieces) if t == BYTE and p == f"<0x{b:02X}>") for b in range(256)], np.int64)
        usable = [i for i, (_, _, t) in enumerate(pieces) if t in (NORMAL, USER)]
        scores = np.array([s for _, s, _ in pieces])
        self.score = scores
        self.unknown = float(scores[usable].min()) - UNKNOWN_PENALTY
        self.by_text = {pieces[i][0]: i for i in usable}
        if any(SPACE == ord(c) for p in self.by_text for c in p.lstrip(chr(SPACE))):
            raise ValueError("pieces that hold a space after another character are not supported")
        if self.kind == MERGES:
            self._merges(usable)
        texts = list(self.by_text)
        self.longest = max(map(len, texts))
        codes = np.array([ord(c) for t in texts for c in t], np.uint32)
        stop = np.cumsum([len(t) for t in texts])
        total, down = code_hashes(codes)
        keys = run_hash(total, down, np.concatenate([[0], stop[:-1]]), stop)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.by_text.values()), np.int64)[order]
        self.slots = np.zeros(1 << 20, bool)
        self.slots[keys & U64((1 << 20) - 1)] = True
        # Neighbours that some piece has; no piece reaches across any others.
        inner = np.ones(len(codes), bool)
        inner[stop - 1] = False
        inner = np.flatnonzero(inner)
        self.neighbours = np.unique(_pairs(codes[inner], codes[inner + 1]))
        self.neighbour_slots = np.zeros(1 << 20, bool)
        self.neighbour_slots[_slot(self.neighbours)] = True

    def apart(self, codes: np.ndarray) -> np.ndarray:
        """For each character after the first, whether no piece holds it and the one before it side by side."""
        key = _pairs(codes[:-1], codes[1:])
        out = ~self.neighbour_slots[_slot(key)]
        ask = np.flatnonzero(~out)
        at = np.searchsorted(self.neighbours, key[ask])
        at[at == len(self.neighbours)] = 0
        out[ask] = self.neighbours[at] != key[ask] if len(self.neighbours) else True
        return out

    def _merges(self, usable: list[int]) -> None:
        """rank (-1 for one character), and the two parts of each piece's last merge; pieces that merging never makes are dropped."""
        order = {s: r for r, s in enumerate(sorted({self.pieces[i][1] for i in usable}, reverse=True))}
        self.rank = np.full(self.size, -1, np.int64)
        self.parts = np.zeros((self.size, 2), np.int64)
        rank_of = {p: order[self.pieces[i][1]] for p, i in self.by_text.items()}
        for text in list(self.by_text):
            symbols, last = list(text), None
            while len(symbols) > 1:
                r, at = min((rank_of.get(symbols[k] + symbols[k + 1], NEVER), k) for k in range(len(symbols) - 1))
                if r == NEVER:
                    break
                last = (symbols[at], symbols[at + 1])
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            i = self.by_text[text]
            if len(symbols) > 1:
                del self.by_text[text]
            elif last:
                self.rank[i] = rank_of[text]
                self.parts[i] = [self.by_text.get(x, -1) for x in last]
        pairs, ranks = [], []
        for text, i in self.by_text.items():
            for k in range(1, len(text)):
                if text[:k] in self.by_text and text[k:] in self.by_text:
                    pairs.append(self.by_text[text[:k]] * self.size + self.by_text[text[k:]])
                    ranks.append(rank_of[text])
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = np.array(pairs, np.int64)[order], np.array(ranks, np.int64)[order]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, next to each other, stay two pieces."""
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), NEVER)
        while len(live):
            key = a * self.size + b
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            joined = np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)
            ra, rb = self.rank[a], self.rank[b]
            early = joined < limit
            out[live[early]] = False
            go = ~early & ((ra >= 0) | (rb >= 0))
            left = ra > rb
            limit = np.where(left, ra, rb + 1)[go]
            a, b = np.where(left, self.parts[a, 1], a)[go], np.where(left, b, self.parts[b, 0])[go]
            live = live[go]
        return out


class Encoder:
    """Encodes blocks of texts; remembers words and pairs from one block to the next."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.forget()
        self.pair_key, self.pair_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def forget(self) -> None:
        self.known, self.first, self.count, self.tokens = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.m.size + b
        slot = (mix(key.astype(U64)) & U64(PAIR_SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(self.pair_key[slot] != key)
        out = self.pair_ok[slot]
        if len(miss):
            own, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            ok = self.m.stable(a[miss][at], b[miss][at])
            out[miss] = ok[back]
            # One pair of each slot is remembered.
            to, one = np.unique(slot[miss][at], return_index=True)
            self.pair_key[to], self.pair_ok[to] = own[one], ok[one]
        return out

    def _window(self, codes: np.ndarray, total: np.ndarray, down: np.ndarray, a: int, b: int) -> np.ndarray:
        """[w, i, k]: the piece of the k + 1 characters of word w that end before place a + i + 1, or -1, for places up to b."""
        m = self.m
        n, length = codes.shape
        width = min(m.longest, length)
        piece = np.full((n, b - a, width), -1, np.int32)
        for k in range(width):
            first = max(a, k)
            if first >= b:
                break
            stop = (np.arange(n)[:, None] * length + np.arange(first + 1, b + 1)).reshape(-1)
            h = run_hash(total, down, stop - k - 1, stop)
            maybe = np.flatnonzero(m.slots[h & U64((1 << 20) - 1)])
            at = np.searchsorted(m.keys, h[maybe])
            at[at == len(m.keys)] = 0
            good = m.keys[at] == h[maybe]
            flat = np.full(len(h), -1, np.int32)
            flat[maybe[good]] = m.ids[at[good]]
            piece[:, first - a :, k] = flat.reshape(n, b - first)
        single = piece[:, :, 0]
        own = codes[:, a:b]
        single[single < 0] = m.size + own[single < 0].astype(np.int32)
        return piece

    def search(self, codes: np.ndarray) -> list[np.ndarray]:
        """Pieces of equally long words, the rows of `codes`; ids of size + c stand for a character c without a piece.

        Long words are searched in windows of WINDOW places; what the next window needs of the one
        before are the survivors of its last places.
        """
        m = self.m
        n, length = codes.shape
        width = min(m.longest, length)
        total, down = code_hashes(codes.reshape(-1))
        best = np.zeros((n, width + 1))  # of place i in column i % (width + 1)
        chosen = np.full((n, length + 1), -1, np.int32)
        back = np.zeros((n, length + 1), np.int16)
        rows = np.arange(n)
        for i in range(1, length + 1):
            if (i - 1) % WINDOW == 0:
                start = i - 1
                piece = self._window(codes, total, down, start, min(start + WINDOW, length))
            some = piece[:, i - 1 - start, : min(width, i)]
            w, k = np.nonzero(some >= 0)
            p, before = some[w, k].astype(np.int64), chosen[w, i - 1 - k].astype(np.int64)
            value = np.full(some.shape, -np.inf)
            if m.kind == UNIGRAM:
                value[w, k] = best[w, (i - 1 - k) % (width + 1)] + np.where(p < m.size, m.score[np.minimum(p, m.size - 1)], m.unknown)
            else:
                free = (before < 0) | (before >= m.size) | (p >= m.size)
                ok = free & (i - 1 - k == 0) | free & (before != -1)
                ask = np.flatnonzero(~free)
                ok[ask] = self.stable(before[ask], p[ask])
                value[w[ok], k[ok]] = 0.0
            # Equal sums: the longest piece.
            back[:, i] = value.shape[1] - 1 - np.argmax(value[:, ::-1], axis=1)
            top = value[rows, back[:, i]]
            best[:, i % (width + 1)] = top
            chosen[:, i] = np.where(top > -np.inf, some[rows, back[:, i]], -2)
        out_row, out_at, out_piece = [], [], []
        place = np.full(n, length)
        while len(rows):
            out_row.append(rows), out_at.append(place), out_piece.append(chosen[rows, place])
            place = place - back[rows, place] - 1
            rows, place = rows[place > 0], place[place > 0]
        row, at, got = np.concatenate(out_row), np.concatenate(out_at), np.concatenate(out_piece)
        order = np.lexsort((at, row))
        return [got[order].astype(np.int64), np.searchsorted(row[order], np.arange(n + 1))]

    def learn(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray) -> None:
        """Encode distinct new words and remember them."""
        tokens, first, count, own = [self.tokens], [], [], []
        base = len(self.tokens)
        for n in np.unique(length):
            which = np.flatnonzero(length == n)
            for part in np.array_split(which, max(1, -(-len(which) * int(n) // CELLS))):
                got, cuts = self.search(codes[start[part][:, None] + np.arange(n)])
                # Characters without a piece become the pieces of their bytes.
                odd = np.flatnonzero(got >= self.m.size)
                many = np.ones(len(got), np.int64)
                raw = [chr(c).encode() for c in got[odd] - self.m.size]
                many[odd] = [len(b) for b in raw]
                ends = np.concatenate([[0], np.cumsum(many)])
                full = np.repeat(got, many)
                full[ranges(ends[odd], many[odd])] = self.m.bytes[np.frombuffer(b"".join(raw), np.uint8)]
                cuts = ends[cuts]
                tokens.append(full), first.append(base + cuts[:-1]), count.append(np.diff(cuts)), own.append(keys[part])
                base += len(full)
        known = np.concatenate([self.known, *own])
        order = np.argsort(known)
        self.known = known[order]
        self.first = np.concatenate([self.first, *first])[order]
        self.count = np.concatenate([self.count, *count])[order]
        self.tokens = np.concatenate(tokens)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's offsets in them. An empty or null text has none."""
        raw, off = text_buffer(column)
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
        size = np.diff(at)
        first = np.concatenate([[0], np.cumsum(size + (size > 0))])
        codes = np.full(first[-1], SPACE, np.uint32)
        codes[ranges(first[:-1] + 1, size)] = np.where(chars == 0x20, SPACE, chars)
        space = codes == SPACE
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[first[:-1][size > 0]] = True
        begin[1:] |= self.m.apart(codes)  # nothing joins these, so what is between them is searched by itself
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(codes))
        total, down = code_hashes(codes)
        h = run_hash(total, down, start, stop)
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        new = ~np.isin(keys, self.known, assume_unique=True)
        if new.any():
            self.learn(codes, start[where[new]], (stop - start)[where[new]], keys[new])
        place = np.searchsorted(self.known, keys)[back]
        many = self.count[place]
        ids = self.tokens[ranges(self.first[place], many)]
        ends = np.concatenate([[0], np.cumsum(many)])
        return ids.astype(np.int32), ends[np.searchsorted(start, first)]


class Decoder:
    def __init__(self, model: PieceModel):
        texts = []
        for i, (p, _, t) in enumerate(model.pieces):
            texts.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(chr(SPACE), " ").encode())
        self.length = np.array([len(t) for t in texts])
        self.start = np.cumsum(self.length) - self.length
        self.buf = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts without the space put in front, and their offsets."""
        size = self.length[ids]
        out = self.buf[ranges(self.start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[off]
        front = ends[:-1][(np.diff(ends) > 0)]
        front = front[out[front] == 0x20]
        keep = np.ones(len(out), bool)
        keep[front] = False
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def load(path: str = MODEL_PATH) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode(docs: DataFrame, model: PieceModel, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array<int> of piece ids. A null or empty text has no ids. A column named like `out` is replaced; all others stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != out]
    docs = docs.select(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` array<int>"])
    state: dict = {}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["e"] = Encoder(sent.value)
        ids, off = state["e"].encode(batch.column(keep.index(text)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))], [*keep, out])

    return map_blocks(docs, schema, each, text)


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of an array<int> of ids; null and empty ids have an empty text.

    Bytes that are not UTF-8 become U+FFFD. A column named like `out` is replaced; all others stay. No
    rows give no rows.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != out]
    rows = rows.select(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` string"])
    state: dict = {}

    def run(batches):
        for batch in batches:
            if "decoder" not in state:
                state["decoder"] = Decoder(sent.value)
            column = batch.column(keep.index(ids))
            off = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
            raw, ends = state["decoder"].decode(column.flatten().to_numpy(zero_copy_only=False), off)
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, out])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def tokenized(docs: DataFrame, model: PieceModel, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip[, ids].

    round_trip: whether decoding gives the text again, byte for byte; false only for texts that hold
    U+2581 themselves, which decoding turns into a space. A null or empty text has no ids and round
    trips. Equal rows are encoded alike, each by itself; no rows give no rows. Ids of documents are
    integers or cast to them. Only the two named columns are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["e"], state["d"] = Encoder(sent.value), Decoder(sent.value)
        column = batch.column(1)
        ids, off = state["e"].encode(column)
        raw, ends = state["d"].decode(ids, off)
        was, at = text_buffer(column)
        same = np.diff(ends) == np.diff(at)
        digests = []
        for t in range(batch.num_rows):
            same[t] = same[t] and bool((raw[ends[t] : ends[t + 1]] == was[at[t] : at[t + 1]]).all())
            digests.append(hashlib.sha256(ids[off[t] : off[t + 1]].astype("<i4").tobytes()).hexdigest())
        out = [batch.column(0), pa.array(np.diff(off)), pa.array(digests), pa.array(same)]
        names = ["doc_id", "n_tokens", "ids_sha256", "round_trip"]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_blocks(rows, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids, each)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(documents(spark, sf_dir), load())
