"""Words and word windows of whole texts as numpy arrays over one UTF-8 byte buffer.

An Arrow string column is one byte buffer with offsets, so a block of texts can be cut into
words, hashed and shingled by a few passes over that buffer, with no Python object per word.
Hashes are 64-bit. A null text is an empty text. Words never reach across two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Words as runs of anything but ASCII white space.
NON_SPACE = ~SPACE
#: Words as runs of ASCII digits, lower-case ASCII letters and non-ASCII bytes.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASES = {"bytes": 0x5851F42D4C957F2D, "words": 0xDA942042E4DD58B5, "check": 0x2545F4914F6CDD1D}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[kind]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 2 * BLOCK_BYTES:
            _powers[kind] = have
    return have[0][:n], have[1][:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most `limit` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


_CHECK = U64(0x452821E638D01377)


def _strings(off: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, buffers).cast(pa.string())


class Words:
    """The words of a block of texts: byte ranges, hashes and the range of words of each text."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, word: np.ndarray = NON_SPACE, lower: bool = False):
        self.buf = ASCII_LOWER[raw] if lower else raw
        self.off = off
        n = len(raw)
        inside = word[self.buf]
        edge = np.zeros(n + 1, np.int8)
        edge[:n] += inside
        edge[1:] -= inside
        # A text border inside a run of word bytes ends one word and begins another.
        border = off[1:-1]
        border = np.unique(border[(border > 0) & (border < n)])
        border = border[inside[border] & inside[border - 1]] if n else border
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(border):
            start = np.sort(np.concatenate([start, border]))
            end = np.sort(np.concatenate([end, border]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off)  # words of text d: first[d] .. first[d + 1]
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = np.empty(len(self), U64)
            at = 0
            while at < len(self):  # stretches of BLOCK_BYTES, so that what is held for them is bounded
                to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + BLOCK_BYTES, "right")))
                self._hash[at:to] = self._hashed(self.start[at:to], self.end[at:to])
                at = to
        return self._hash

    def _hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = start[0], end[-1]
        up, down = _power("bytes", high - low + 1)
        total = np.zeros(high - low + 1, U64)
        np.cumsum(_BYTE[self.buf[low:high]] * up[:-1], out=total[1:])
        return mix((total[end - low] - total[start - low]) * down[start - low] + (end - start).astype(U64))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which `size` words of one text begin, and the hash of those words."""
        n = len(self)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        last = np.repeat(self.first[1:], self.counts) - size
        at = np.flatnonzero(np.arange(n) <= last)
        return at, self.gram_hash(at, size)

    def gram_hash(self, at: np.ndarray, size, check: bool = False) -> np.ndarray:
        """Hash of the `size` words (a number, or one for each position) that begin at each position; with `check`, another one."""
        up, down = _power("check" if check else "words", len(self) + 1)
        total = np.zeros(len(self) + 1, U64)
        np.cumsum((mix(self.hash ^ _CHECK) if check else self.hash) * up[:-1], out=total[1:])
        return mix((total[at + size] - total[at]) * down[at] + np.asarray(size).astype(U64))

    def texts(self) -> pa.Array:
        """The texts, of one block whose buffer is theirs alone."""
        return _strings(self.off, self.buf)

    def joined(self, at: np.ndarray, count: np.ndarray) -> pa.Array:
        """For each position the words at .. at + count - 1, joined by single spaces."""
        return self.joined_words(ranges(at, count), count)

    def joined_words(self, which: np.ndarray, count: np.ndarray) -> pa.Array:
        """Strings of the words `which`, the first count[0] of them, the next count[1] and so on, joined by single spaces."""
        size = self.end[which] - self.start[which]
        step = size + 1
        some = count > 0
        step[np.cumsum(count)[some] - 1] -= 1
        ends = np.concatenate([[0], np.cumsum(step)])
        out = np.full(int(ends[-1]), 0x20, np.uint8)
        out[ranges(ends[:-1], size)] = self.buf[ranges(self.start[which], size)]
        return _strings(ends[np.concatenate([[0], np.cumsum(count)])], out)

    def word_bytes(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for `length[0]` values, then the same for each other range."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each pair of byte ranges of equal length, whether their bytes are the same."""
    if not len(length):
        return np.zeros(0, bool)
    differs = a[ranges(at_a, length)] != b[ranges(at_b, length)]
    bad = np.concatenate([[0], np.cumsum(differs)])
    stop = np.cumsum(length)
    return bad[stop] == bad[stop - length]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.int64).view(U64)
