"""Words of many texts at once, as 64-bit hashes, with numpy: what the models of running text count and look up."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

#: Odd multipliers, and the end of a text as a token.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END = np.uint64(0xE4D7E4D7E4D7E4D7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of a after b."""
    out = (a ^ (a >> np.uint64(32))) * M1 + b
    out ^= out >> np.uint64(29)
    out *= M2
    return out ^ (out >> np.uint64(32))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; ``data`` ends with a gap."""
    gap = GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes between begin and end, eight at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = end - begin
    out = size.astype(np.uint64) * M2
    at = np.flatnonzero(size <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        at = at[size[at] > step]
        if not len(at):
            break
        block = eights[begin[at] + step] & MASKS[np.minimum(size[at] - step, 8)]
        out[at] = mixed(block, out[at])
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return out


class Texts:
    """Texts in lower case (A-Z) as tokens: their words, and after each text an end.

    ``tokens``: hashes; ``sizes``: tokens of each text; ``spelt``, ``begin`` and ``end``: bytes, and where the words stand in them;
    ``first``: where each text's tokens begin.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.n_bytes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.spelt = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        self.begin, self.end = word_spans(self.spelt)
        upto = np.searchsorted(self.begin, np.cumsum(self.n_bytes + 1))
        n_words = np.diff(upto, prepend=0)
        self.sizes = n_words + 1
        ends = np.cumsum(self.sizes) - 1
        self.first = ends - n_words
        self.tokens = np.empty(len(self.begin) + len(raw), np.uint64)
        self.is_word = np.ones(len(self.tokens), bool)
        self.is_word[ends] = False
        self.tokens[self.is_word] = hashes(self.spelt, self.begin, self.end)
        self.tokens[ends] = END

    def before(self, n: int = 1) -> np.ndarray:
        """The token ``n`` before each; 0 where the text had not begun."""
        out = np.zeros(len(self.tokens), np.uint64)
        out[n:] = self.tokens[:-n]
        for i in range(n):
            at = self.first + i
            out[at[i < self.sizes]] = 0
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First words (as tokens) and numbers of words of all lines."""
        stops = np.flatnonzero(self.spelt == 10)
        upto = np.searchsorted(self.begin, stops)
        n = np.diff(upto, prepend=0)
        text = np.searchsorted(np.cumsum(self.n_bytes + 1), stops, side="right")  # a text's last line ends at its closing mark
        return upto - n + text, n


def line_hashes(tokens: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the sequences of ``n`` > 0 tokens from ``at`` on."""
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    each = mixed(tokens[np.repeat(at, n) + place], (place.astype(np.uint64) + np.uint64(1)) * M1)
    return np.add.reduceat(each, np.cumsum(n) - n) if len(n) else np.empty(0, np.uint64)


#: Bytes of text of a chunk, about.
CHUNK_BYTES = 8 << 20


def cut(batches, names: tuple[str, ...], most: int = CHUNK_BYTES):
    """Chunks of a partition's rows (text and ``names``): number, columns as lists, ``Texts``. Their size is bounded, but for one long text."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    rows, texts, size = {k: [] for k in names}, [], 0
    for batch in batches:
        columns = {k: batch.column(k).to_pylist() for k in names}
        for i, text in enumerate(batch.column("text")):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            for k in names:
                rows[k].append(columns[k][i])
            if size >= most:
                yield chunk, rows, Texts(texts)
                chunk, rows, texts, size = chunk + 1, {k: [] for k in names}, [], 0
    if texts:
        yield chunk, rows, Texts(texts)


def shard_bits(docs, bytes_of_shard: int = 8 << 20) -> int:
    """Shards are 2**bits, as many as Spark's estimate of the size of ``docs`` asks for; the estimate sets the size of tasks only."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(3, (size // bytes_of_shard).bit_length()), 20)


def shard_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the shards begin in sorted keys: a shard is a value of the upper ``bits``."""
    return np.concatenate((np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]))


def packed(values: np.ndarray, level: int = 1) -> bytes:
    """Whole numbers below 2**32 as planes of their bytes, compressed: upper planes are nearly empty."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()
