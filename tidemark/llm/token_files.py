"""Token-id files: ids of documents in ascending order of doc_id, packed by a context-mixing range coder.

File (little-endian): "TMTK", version u16, tables of order 0 u16, ids of a block u32, documents u32, ids u32, distinct ids u32, pairs u32, blocks u32; then documents'
ids i64 with a flag for null, their counts u32; distinct ids u32, pairs of symbols 2 u16, and for each table the symbols' quantised frequencies u16, which add up to 2**16; for
each block its bytes u32, the CRC-32 of its ids u32 and its symbols u32; then the blocks' bytes.

Symbols are the distinct ids, and pairs of symbols that the file often has: a pair may be part of a later one. Below, "id" is a symbol.
A block is coded on its own: all adaptive state starts anew and no pair goes over its end, so a block can be read without others and its checksum tells damage.
An id is foretold by three orders. Order 2, by the last two ids, and order 1, by the last id, have a hashed table each of the id that followed and how well it
did; the better known of the two is the candidate. That the id is the candidate is one decision, whose log-odds by orders 2, 1 and 0
are added with adaptive weights, from a set selected by how well both cells did and whether they agree. Any other id goes by order 0 in one step of
a range coder with carry: by one of a few tables of frequencies of the file (texts of one language are alike), the one that suited
the block's last ids. All arithmetic is in whole numbers, so that any machine decodes what another has coded.

Blocks are coded side by side: each numpy step codes one id of each of up to ``SIDE_BY_SIDE`` blocks of a file. The same loop encodes and decodes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .bpe import byte_letters, vocabulary_path
from .common import documents, tuned, written

END_ID, BLOCK_IDS, FILE_IDS = 1, 4096, 8 << 20
#: Bytes of texts of which words are told apart at once.
SLICE_BYTES = 8 << 20
#: Blocks that are coded side by side, of 9 KB of state each: a file of any length takes no more.
SIDE_BY_SIDE = 2048
#: Bits of the index of a block's tables; the rate of the weights and their sets.
CELL_BITS, WEIGHT_SHIFT = 10, 10
#: Frequencies of order 0: tables of a file, ids of a piece that has one while they are found, every how many pieces, rounds.
TABLES, PIECE, EVERY, ROUNDS = 4, 256, 4, 4
#: Pairs: symbols of a file with them, bits of the index of pairs, rounds, of which pieces they are counted, how often one is there at least. Symbols that are joined at once.
SYMBOLS, PAIR_BITS, PAIR_ROUNDS, PAIR_EVERY, PAIR_LEAST, JOINED = 1 << 15, 18, 4, 8, 4, 1 << 18
HEADER = struct.Struct("<4sHHIIIIII")

#: log(p / (1 - p)) of chances, with 8 bits after the point, of 12 bits, and its inverse, by 2048 more, of 16 bits.
STRETCH = np.clip(np.rint(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.int32)
SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-(np.arange(4096) - 2048) / 256))), 16, 65520).astype(np.int32)
#: By hit * 4096 + its chance of 12 bits, how wrong that was, four times as one element.
ERRORS = np.repeat(np.concatenate((-np.arange(4096), 4096 - np.arange(4096))).astype(np.int32), 4).view(np.complex128)


def states() -> tuple[np.ndarray, ...]:
    """By how well the cells of order 2 and 1 did and whether they hold one id (seen * 32 + seen * 2 + same): whether the candidate is that of order 1 (if not of 2),
    log-odds of the candidate by order 2 and 1 (four numbers as one element), and the set of weights. Where both cells are empty the candidate is id 0, which is unlikely."""
    two, one, same = (x.ravel() for x in np.meshgrid(np.arange(16), np.arange(16), np.arange(2), indexing="ij"))
    of_two = STRETCH[np.array([2048, 340, 2500, 3500, 3800, 3880, *[3930] * 10])]
    of_one = STRETCH[np.array([0, 150, 700, 1300, 1800, 2000, *[2200] * 10])]
    pick = (two == 0) | ((two == 1) & (one > 2) & (same == 0))
    by_two = np.where(pick, np.where(one > 0, -64 * np.minimum(two, 4), -1400), of_two[two])
    by_one = np.where(pick, of_one[one], np.where(same == 1, 128, -32) * np.minimum(one, 4))
    gate = np.where(pick, 8 + np.minimum(one, 7), np.minimum(two, 3) + 4 * same)
    return pick.astype(np.int32), np.ascontiguousarray(np.stack((by_two, by_one, 0 * gate, 0 * gate), axis=1).astype(np.int32)).view(np.complex128).ravel(), gate


PICK, ORDERS, GATE = states()
WHOLE = np.uint64(1 << 16)
#: First weights (of 65536) of orders 2 to 0.
GATES, FIRST_WEIGHTS = 16, np.array([65536, 65536, 3000], np.int32)


def quantised(counts: np.ndarray, total_bits: int = 16) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**total_bits."""
    total = 1 << total_bits
    f = np.maximum(1, counts * total // max(1, int(counts.sum()))).astype(np.int64)
    over = int(f.sum()) - total
    if over <= 0:
        f[int(counts.argmax())] -= over
        return f
    order = np.argsort(-f, kind="stable")
    while over > 0:  # take from the largest, at most half of each
        for i in order:
            take = min(over, int(f[i]) // 2)
            f[i] -= take
            over -= take
            if not over:
                break
    return f


class Order0:
    """Tables (tables, ids) of frequencies that add up to 2**16 each, as the coder looks them up; ``cost`` in 1/16 bits."""

    def __init__(self, freq: np.ndarray):
        self.n = freq.shape[1]
        self.parts = (((np.cumsum(freq, axis=1) - freq) << 32) | freq).astype(np.uint64).ravel()  # the sum of those before, and the frequency
        self.symbol = np.repeat(np.tile(np.arange(self.n, dtype=np.uint16), len(freq)), freq.ravel())
        self.cost = np.ascontiguousarray(np.rint(16 * (16 - np.log2(freq))).astype(np.int32).T).view(f"V{4 * len(freq)}").ravel()  # of all tables as one element
        self.odds = STRETCH[np.minimum(freq.max(axis=0) >> 4, 4095)]


class Pairs:
    """Pairs (first, second) of symbols that are one symbol, numbered on from ``n`` ids; where two overlap, the later one goes first."""

    def __init__(self, n: int, pairs: np.ndarray):
        self.n, self.pairs = n, pairs
        self.keys = np.concatenate((np.zeros(1, np.uint32), (pairs[:, 0].astype(np.uint32) << np.uint32(16)) | pairs[:, 1]))
        self.slots = np.zeros(1 << PAIR_BITS, np.uint16)  # of pairs in one place the last is found
        self.slots[self.place(self.keys[1:])] = np.arange(1, len(self.keys))

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - PAIR_BITS)

    def join(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with pairs made one, and where their blocks end."""
        keys = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        found = self.slots.take(self.place(keys))
        found *= self.keys.take(found) == keys
        found[ends[:-1] - 1] = 0
        chosen = found > 0
        chosen[1:] &= found[1:] > found[:-1]
        chosen[:-1] &= found[:-1] >= found[1:]
        at = np.flatnonzero(chosen)
        out, stay = symbols.copy(), np.ones(len(symbols), bool)
        out[at], stay[at + 1] = found[at] + np.uint32(self.n - 1), False
        return out[stay], ends - np.searchsorted(at, ends - 1)

    def joined(self, index: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of blocks of so many ids, and how many each has."""
        if not len(self.pairs):
            return index, np.diff(np.append(np.arange(0, len(index), block), len(index)))
        found, sizes, step = [], [], max(1, JOINED // block) * block
        for i in range(0, len(index), step):
            symbols = index[i : i + step].astype(np.uint32)
            ends = np.append(np.arange(block, len(symbols), block), len(symbols))
            for _ in range(PAIR_ROUNDS + 1):
                symbols, ends = self.join(symbols, ends)
            found.append(symbols.astype(np.int32))
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(found), np.concatenate(sizes)

    def parted(self, symbols: np.ndarray, most: int) -> np.ndarray:
        """Ids of symbols, of which none may have more than ``most``."""
        if not len(self.pairs):
            return symbols
        spelt = [(i,) for i in range(self.n)]
        for a, b in self.pairs.tolist():
            if max(a, b) >= len(spelt) or len(spelt[a]) + len(spelt[b]) > most:
                raise ValueError("damaged pairs")
            spelt.append(spelt[a] + spelt[b])
        size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        pool, begin, out = np.fromiter((i for x in spelt for i in x), np.int32, int(size.sum())), np.cumsum(size) - size, []
        for i in range(0, len(symbols), JOINED):
            sizes = size.take(symbols[i : i + JOINED])
            place = np.repeat(begin.take(symbols[i : i + JOINED]) - (np.cumsum(sizes) - sizes), sizes)
            place += np.arange(len(place))
            out.append(pool.take(place))
        return np.concatenate(out)


def frequent_pairs(index: np.ndarray, n: int, block: int) -> Pairs:
    """In rounds, the most frequent pairs of the pieces of a file, in which those of rounds before are one symbol."""
    pairs, block = Pairs(n, np.zeros((0, 2), np.uint16)), min(block, PIECE)
    pieces = index[: len(index) // block * block].reshape(-1, block)[::PAIR_EVERY]
    symbols, ends = pieces.astype(np.uint32).ravel(), np.arange(1, len(pieces) + 1) * block
    for left in range(PAIR_ROUNDS, 0, -1):
        room = (SYMBOLS - n - len(pairs.pairs)) // left
        if room <= 0 or len(symbols) < 2:
            break
        keys = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        keys = np.sort(np.delete(keys, ends[:-1] - 1))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        times, keys = np.diff(first, append=len(keys)), keys[first]
        new = (times >= PAIR_LEAST) & ~np.isin(keys, pairs.keys[1:])
        keys = keys[new][np.argsort(times[new], kind="stable")[-room:]]
        if not len(keys):
            break
        pairs = Pairs(n, np.concatenate((pairs.pairs, np.stack((keys >> np.uint32(16), keys & np.uint32(0xFFFF)), axis=1).astype(np.uint16))))
        symbols, ends = pairs.join(symbols, ends)
    return pairs


def order0_tables(index: np.ndarray, n: int) -> np.ndarray:
    """Frequencies of ``n`` ids 0, 1, ... in up to ``TABLES`` tables: pieces of the file go to the table that codes them best, and each table is counted anew
    from its pieces, some rounds long. First tables are the pieces that those before code worst. All ids are in each table."""
    all_counts = np.bincount(index, minlength=n)
    pieces = index[: len(index) // PIECE * PIECE].reshape(-1, PIECE)[::EVERY]
    if len(pieces) < 16 * TABLES:
        return quantised(all_counts)[None]

    def costs(counts: np.ndarray) -> np.ndarray:
        share = counts / counts.sum() * 0.8 + all_counts / len(index) * 0.2
        return -np.log2(np.maximum(share, 1e-12)).astype(np.float32)[pieces].sum(axis=1)

    counts = [np.bincount(pieces[0], minlength=len(all_counts))]
    found = [costs(counts[0])]
    while len(found) < TABLES:
        counts.append(np.bincount(pieces[np.min(found, axis=0).argmax()], minlength=len(all_counts)))
        found.append(costs(counts[-1]))
    for _ in range(ROUNDS):
        best = np.argmin(found, axis=0)
        counts = [np.bincount(pieces[best == k].ravel(), minlength=len(all_counts)) for k in range(TABLES) if (best == k).any()]
        if len(counts) < TABLES:
            break
        found = [costs(c) for c in counts]
    total = np.array([c.sum() for c in counts])
    return np.stack([quantised(np.rint((c / t + 0.02 * all_counts / len(index)) * (1 << 40)).astype(np.int64) // 1) for c, t in zip(counts, total)])


def code_blocks(model: Order0, lengths: np.ndarray, ids: np.ndarray | None = None, data: list[bytes] | None = None) -> list[bytes] | np.ndarray:
    """Encodes ``ids`` (blocks, steps), indexes of the model's ids, to bytes by block; or decodes ``data`` to them. Blocks are in falling order of length."""
    n, steps = len(lengths), int(lengths.max())
    if data is None:
        width = steps * 7 // 8 + 64
        words, ends = np.zeros(n * width, np.uint32), np.zeros(n, np.int64)
        low, turned, used = np.zeros(n, np.uint64), np.ascontiguousarray(ids.T), np.arange(n) * width
    else:
        width = max(map(len, data)) // 2 + 4
        source = np.frombuffer(b"".join(d.ljust(2 * width, b"\0") for d in data), "<u2").astype(np.uint64)
        out, used = np.zeros((steps, n), np.int32), np.arange(n) * width
        value = (source[used] << np.uint64(32)) | (source[used + 1] << np.uint64(16)) | source[used + 2]
        used += 3
    scale = np.full(n, 1 << 48, np.uint64)
    # a block's weights of a set are one element, four numbers, of which three are in use
    table, weights = np.zeros(2 * n << CELL_BITS, np.uint32), np.tile(np.append(FIRST_WEIGHTS, np.int32(0)), n * GATES).view(np.complex128)
    base, each = (np.arange(2)[:, None] * n + np.arange(n)) << CELL_BITS, np.arange(n) * GATES
    contexts, mark = np.zeros((2, n), np.uint32), np.zeros(n, np.uint32)
    costs = np.zeros((n, model.cost.itemsize // 4), np.int32)
    shift, slots = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = (n - np.searchsorted(lengths[::-1], np.arange(steps), side="right")).tolist()
    for step in range(steps):
        m = alive[step]
        if m < n:  # the last blocks are over
            if data is None:
                finish(words, ends, low, used, width, m)
                low = low[:m]
            else:
                value = value[:m]
            n, scale, used, mark, shift, slots, each, costs = m, scale[:m], used[:m], mark[:m], shift[:m], slots[:m], each[:m], costs[:m]
            base, contexts = (np.ascontiguousarray(x[:, :m]) for x in (base, contexts))
        at = base + (contexts >> np.uint32(32 - CELL_BITS))
        cells = table.take(at)
        ids_held, seen = cells >> np.uint32(4), cells.astype(np.uint16) & np.uint16(15)
        held = ids_held.view(np.int32)
        state = (seen[0] << np.uint16(5)) + (seen[1] << np.uint16(1))
        state += held[0] == held[1]
        state = state.astype(np.int64)
        candidate = held[1] - held[0]
        candidate *= PICK.take(state)
        candidate += held[0]
        odds = ORDERS.take(state).view(np.int32).reshape(n, 4)
        odds[:, 2] = model.odds.take(candidate, mode="clip")
        places = each + GATE.take(state)
        own = weights.take(places).view(np.int32).reshape(n, 4)
        total = own * odds
        total = total[:, 0] + total[:, 1] + total[:, 2]
        total >>= 16
        total += 2048
        p = SQUASH.take(total, mode="clip")
        share = p.astype(np.uint64)
        scale >>= np.uint64(16)
        if data is None:
            symbol = turned[step, :n]
            miss = (candidate != symbol).astype(np.uint64)
        else:
            miss = (value >= scale * share).astype(np.uint64)
        hit = miss.astype(np.int32) ^ np.int32(1)
        # what is not the candidate goes by order 0: its share is what is left
        start, whole = share * miss, miss << np.uint64(16)
        share += whole
        share -= start
        share -= start
        np.subtract(WHOLE, whole, out=whole)
        if data is None:
            low += scale * start
            scale *= share
            scale >>= np.uint64(16)
        else:
            value -= scale * start
            scale *= share
            scale >>= np.uint64(16)
            slot = value // scale
            np.minimum(slot, np.uint64(65535), out=slot)
            symbol = model.symbol.take(slot.view(np.int64) + slots).astype(np.int32)
        part = model.parts.take(symbol + shift)
        part *= miss
        part += whole
        if data is None:
            low += scale * (part >> np.uint64(32))
        else:
            value -= scale * (part >> np.uint64(32))
            candidate -= symbol
            candidate *= hit
            symbol += candidate
            out[step, :n] = symbol
        part &= np.uint64(0xFFFFFFFF)
        scale *= part
        p >>= 4
        hit <<= 12
        p += hit
        odds *= ERRORS.take(p).view(np.int32).reshape(n, 4)
        odds >>= WEIGHT_SHIFT
        odds += own
        weights[places] = odds.view(np.complex128).ravel()
        fresh = symbol.astype(np.uint32)
        # a cell holds an id and, in 4 bits below, how well it did (0: empty): one more for a hit, half for a miss, and below 2 another id comes
        match = held == symbol
        gone = (seen < 2) > match
        less = seen >> np.uint16(1)
        seen += np.uint16(1)
        np.minimum(seen, np.uint16(15), out=seen)
        seen -= less
        seen *= match
        seen += less
        seen += gone
        ids_new = fresh - ids_held
        ids_new *= gone
        ids_new += ids_held
        ids_new <<= np.uint32(4)
        ids_new |= seen
        table[at] = ids_new
        fresh += np.uint32(1)
        fresh *= np.uint32(0x9E3779B1)
        np.multiply(mark ^ (fresh >> np.uint32(7)), np.uint32(0x27D4EB2F), out=contexts[0])
        contexts[1] = mark = fresh
        short = scale < np.uint64(1 << 32)
        while short.any():
            by = short.astype(np.uint64)
            if data is None:
                word = low >> np.uint64(32)
                words[used] = word  # what is not short writes there again
                word *= by
                low -= word << np.uint64(32)
                by <<= np.uint64(4)
                low <<= by
            else:
                word = source.take(used, mode="clip")
                word *= by
                by <<= np.uint64(4)
                value <<= by
                value |= word
            scale <<= by
            used += short
            short = scale < np.uint64(1 << 32)
        if data is None and not step & 15 and (used - np.arange(n) * width).max() + 64 > width:
            words = np.concatenate((words.reshape(-1, width), np.zeros((len(words) // width, width), np.uint32)), axis=1).ravel()
            used += np.arange(n) * width
            width *= 2
        if step & 31 == 31 and costs.shape[1] > 1:
            last = (out if data is not None else turned)[step - 31 : step + 1, :n]
            costs -= costs >> 2
            costs += model.cost.take(last).view(np.int32).reshape(len(last), *costs.shape).sum(axis=0, dtype=np.int32)
            choice = costs.argmin(axis=1)
            shift, slots = choice * model.n, choice << 16
    if data is not None:
        return out.T
    finish(words, ends, low, used, width, 0)
    words = words.reshape(-1, width)
    for j in range(width - 1, 0, -1):  # what ran over
        words[:, j - 1] += words[:, j] >> np.uint32(16)
    words = words.astype("<u2")
    return [words[i, :e].tobytes() for i, e in enumerate(ends)]


def finish(words: np.ndarray, ends: np.ndarray, low: np.ndarray, used: np.ndarray, width: int, first: int) -> None:
    """One word more of the blocks from ``first`` on ends them: behind it a reader finds zeros."""
    words[used[first:]] = (low[first:] + np.uint64(0xFFFFFFFF)) >> np.uint64(32)
    ends[first : len(low)] = used[first:] + 1 - np.arange(first, len(low)) * width


def slices(n: int) -> list[slice]:
    """Of ``n`` blocks, equal parts of no more than are coded side by side."""
    ends = np.linspace(0, n, -(-n // SIDE_BY_SIDE) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """A file of documents whose ids stand one after another."""
    values = np.flatnonzero(np.bincount(ids))
    n_blocks = -(-len(ids) // block_ids)
    parts, checks, lengths = [b""] * n_blocks, [], np.zeros(0, np.int64)
    freq, pairs = np.empty((0, 0), np.int64), np.zeros((0, 2), np.uint16)
    if n_blocks:
        place = np.zeros(values[-1] + 1, np.int32)
        place[values] = np.arange(len(values))
        index = place[ids]
        joined = frequent_pairs(index, len(values), block_ids)
        pairs = joined.pairs
        index, lengths = joined.joined(index, block_ids)
        freq = order0_tables(index, len(values) + len(pairs))
        model, begin, order = Order0(freq), np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
        for s in slices(n_blocks):
            of = order[s]
            found = code_blocks(model, lengths[of], ids=index.take(begin[of][:, None] + np.arange(lengths[of[0]]), mode="clip"))
            for i, p in zip(of.tolist(), found, strict=True):
                parts[i] = p
        checks = [crc_of(ids[i : i + block_ids]) for i in range(0, len(ids), block_ids)]
    head = HEADER.pack(b"TMTK", 3, len(freq), block_ids, len(doc_ids), len(ids), len(values), len(pairs), n_blocks)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    index_table = b"".join(struct.pack("<III", len(p), c, n) for p, c, n in zip(parts, checks, lengths.tolist(), strict=True))
    return b"".join((head, known.tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), values.astype("<u4").tobytes(), pairs.astype("<u2").tobytes(), (freq - 1).astype("<u2").tobytes(), index_table, *parts))


def unpack(file: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their counts, and all ids; a ValueError if a block's checksum is not that of its ids."""
    magic, version, n_tables, block_ids, n_docs, n_ids, n_values, n_pairs, n_blocks = HEADER.unpack_from(file)
    if magic != b"TMTK" or version != 3:
        raise ValueError("not a token-id file")
    at = HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(file, kind, n, at)
        at += out.nbytes
        return out

    known, null, counts, values, pairs = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("<u4", n_values), take("<u2", 2 * n_pairs).reshape(-1, 2)
    freq = take("<u2", n_tables * (n_values + n_pairs)).astype(np.int64).reshape(n_tables, n_values + n_pairs) + 1
    table = take("<u4", 3 * n_blocks).reshape(-1, 3).astype(np.int64)
    data, lengths = [], table[:, 2]
    for size in table[:, 0].tolist():
        data.append(file[at : at + size])
        at += size
    ids = np.empty(0, np.uint32)
    if n_blocks:
        if lengths.min() < 1 or lengths.max() > block_ids:
            raise ValueError("damaged lengths of blocks")
        model, begin, order = Order0(freq), np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
        index = np.empty(int(lengths.sum()), np.int32)
        for s in slices(n_blocks):
            of = order[s]
            steps = np.arange(lengths[of[0]])
            there = steps < lengths[of][:, None]
            index[(begin[of][:, None] + steps)[there]] = code_blocks(model, lengths[of], data=[data[i] for i in of.tolist()])[there]
        ids = values[Pairs(n_values, pairs).parted(index, block_ids)].astype(np.uint32)
        for i, check in enumerate(table[:, 1].tolist()):
            if crc_of(ids[i * block_ids : (i + 1) * block_ids]) != check:
                raise ValueError(f"block {i} is damaged")
        if len(ids) != n_ids:
            raise ValueError("more ids than were written")
    return [None if z else int(d) for d, z in zip(known, null, strict=True)], counts.astype(np.int64), ids


#: What a byte is in words of ASCII and of the letters from U+00C0 to U+00FF: 1 a gap, 2 a letter, 3 a digit, 4 another sign; 0: the word is not of these, or an
#: apostrophe is in it, with which endings are split off.
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = 4
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = 2
KINDS[0x30:0x3A] = 3
KINDS[0x20], KINDS[0x27] = 1, 0


#: Code points of bytes in the byte-level alphabet; a space stays, which no piece has.
LETTERS = np.array(list(map(ord, byte_letters())), np.uint32)
LETTERS[0x20] = 0x20
#: Bytes of characters of which Unicode's versions tell differently, and controls that are white space to some.
RAW = (*range(0x1C, 0x20), *range(0xC9, 0x100))
#: Kinds of bytes: 0 a gap, 1 an ASCII letter, 2 a sign, 3 an apostrophe, 4 a digit, 5 one of ``RAW``, 6 first and 7 next of a letter of two bytes (if so), 8 another.
GAP, LETTER, SIGN, APOSTROPHE, DIGIT, UNSURE, LEAD, NEXT, OTHER = range(9)
TEXT_KINDS = np.full(256, OTHER, np.uint8)
TEXT_KINDS[0x21:0x7F], TEXT_KINDS[0x30:0x3A], TEXT_KINDS[0x27] = SIGN, DIGIT, APOSTROPHE
TEXT_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
TEXT_KINDS[[*range(0x80, 0xC0)]], TEXT_KINDS[0xC3], TEXT_KINDS[[*RAW]], TEXT_KINDS[[0x20, *range(0x09, 0x0E)]] = NEXT, LEAD, UNSURE, GAP
#: Whether a word begins between two bytes, by kind * 16 + kind: 1 behind a gap, 2 where one of the library's pieces ends for sure, 3 if the two bytes are a letter.
BEGINS = np.zeros(256, np.uint8)
BEGINS[GAP * 16 + 1 : GAP * 16 + OTHER + 1] = 1
for _a, _bs in ((LETTER, (SIGN, APOSTROPHE, DIGIT)), (SIGN, (LETTER, DIGIT)), (APOSTROPHE, (DIGIT,)), (DIGIT, (LETTER, SIGN, APOSTROPHE, DIGIT))):
    BEGINS[[_a * 16 + _b for _b in _bs]] = 2
BEGINS[[SIGN * 16 + LEAD, DIGIT * 16 + LEAD, NEXT * 16 + SIGN, NEXT * 16 + APOSTROPHE, NEXT * 16 + DIGIT]] = 3
LOWER, GAPS = bytes(range(256)).lower(), bytes(np.flatnonzero(TEXT_KINDS == GAP).tolist())


def pretokens(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words without gaps: how many pieces the library makes of each before merging, runs of letters and of other signs, and digits (-1 where it is not as plain as
    that); all bytes, in lower case and a space behind each word; and where pieces start."""
    data = np.frombuffer((" ".join(words) + " ").encode(), np.uint8).copy()
    kinds = KINDS[data]
    before = np.concatenate((data[:1] * 0, data[:-1]))
    high = data >= 0x80
    # two bytes of a letter, no signs of multiplication or division; nothing that a special may begin with
    odd = (kinds == 0) | ((data == 0x7C) & (before == 0x3C)) | (high & (data < 0xC0) & ((before != 0xC3) | (data == 0x97) | (data == 0xB7)))
    starts = ((kinds != np.concatenate((kinds[:1] * 0, kinds[:-1]))) | (kinds == 3)) & (kinds > 1)
    ends = np.flatnonzero(data == 0x20)
    upto, odd_upto = np.cumsum(starts)[ends], np.cumsum(odd)[ends]
    data[((data >= 0x41) & (data <= 0x5A)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E))] += 0x20
    return np.where(np.diff(odd_upto, prepend=0) > 0, -1, np.diff(upto, prepend=0)), data, starts


def plain_tokenizer(path: str) -> Tokenizer:
    """The library with the file's model, for pieces of the byte-level alphabet that stand between spaces. Pieces seldom come again, so it remembers none."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    out = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
    out.pre_tokenizer = CharDelimiterSplit(" ")
    return out


class WordIds:
    """The library's ids of what stands between white space, remembered up to so many bytes, by all tasks of a worker. The distinct words of some texts are looked up
    once, and those not met before go to the library together. Words of more than ``LONG`` letters are not remembered beyond a call."""

    MEMORY, LONG, TOGETHER = 320 << 20, 64, 2000

    def __init__(self, path: str):
        self.library, self.plain = Tokenizer.from_file(path), plain_tokenizer(path)
        self.known: dict[str, bytes] = {}  # ids as 16-bit numbers
        self.held = 0
        self.ends = np.zeros(1 << 16, bool)  # ids that end a piece
        self.ends[[i for t, i in self.library.get_vocab(False).items() if t.endswith("</w>")]] = True

    def keep(self, words: list[str], ids: bytes, ends: list[int]) -> None:
        self.known.update(zip(words, [ids[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        self.held += 180 * len(words) + 4 * sum(map(len, words)) + len(ids)

    def learn(self, words: list[str]) -> None:
        """Words of plain pieces go to the model with spaces between pieces, over which no id reaches, and are parted again by the ids that end pieces."""
        odd = []
        for i in range(0, len(words), self.TOGETHER):
            ws = words[i : i + self.TOGETHER]
            n, data, starts = pretokens(ws)
            if (n < 0).any():
                odd += [ws[k] for k in np.flatnonzero(n < 0)]
                ws = [ws[k] for k in np.flatnonzero(n >= 0)]
                if not ws:
                    continue
                n, data, starts = pretokens(ws)
            starts[1:] &= data[:-1] != 0x20  # a space stands there
            starts[0] = False
            text = np.insert(LETTERS[data], np.flatnonzero(starts), 0x20)
            ids = np.array(self.plain.encode_batch_fast([text.astype("<u4").tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint16)
            at, upto = np.flatnonzero(self.ends[ids]), np.cumsum(n)
            if len(at) != upto[-1]:
                self.learn_by_place(ws)
            else:
                self.keep(ws, ids.tobytes(), (2 * np.concatenate(([0], at + 1))[upto]).tolist())
        self.learn_by_place(odd)

    def learn_by_place(self, words: list[str]) -> None:
        """One call for all words, which are parted again by where ids begin."""
        e = self.library.encode(" ".join(words), add_special_tokens=False)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes + 1) - sizes - 1
        of = np.searchsorted(begin, np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), side="right") - 1
        self.keep(words, np.array(e.ids, np.uint16).tobytes(), (2 * np.cumsum(np.bincount(of, minlength=len(words)))).tolist())

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        ids = list(map(self.known.get, words))
        new = [w for w, i in zip(words, ids, strict=True) if i is None]
        if new:
            if self.held > self.MEMORY:
                self.known.clear()
                self.held = 0
            self.learn(new)
            known = self.known
            ids = [known[w] if i is None else i for w, i in zip(words, ids, strict=True)]
            for w in new:
                if len(w) > self.LONG:
                    self.held -= 180 + 4 * len(w) + len(known.pop(w))
        return ids

    def __call__(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and all ids. In lower case, words that differ in capitals only are one, and so are those that differ in signs at their ends."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        words, n_words = parts_of(texts)
        found = words.dictionary_encode()
        ids = self.of_words(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        pool, begin = np.frombuffer(b"".join(ids), np.uint16), np.cumsum(size) - size
        each = found.indices.to_numpy()
        sizes = size[each]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        place = np.repeat(begin[each] - upto[:-1], sizes)
        place += np.arange(len(place))
        return np.diff(upto[np.cumsum(n_words)], prepend=0), pool[place].astype(np.uint32)


def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, parted where one of the library's pieces ends for sure (between letters, digits and signs, not behind an apostrophe), so that a word is the same with and
    without a sign behind it, and in lower case; and how many each text has. Texts with "<|" (specials are told by their letters) or anything of ``RAW`` are parted at gaps only."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    raw = data.tobytes()
    kinds = np.frombuffer(raw.translate(TEXT_KINDS.tobytes()), np.uint8)
    begins = np.zeros(len(data), np.uint8)
    begins[1:] = np.frombuffer(((kinds[:-1] << np.uint8(4)) | kinds[1:]).tobytes().translate(BEGINS.tobytes()), np.uint8)
    first = at[:-1][np.diff(at) > 0]
    begins[first] = kinds[first] != GAP
    inside = kinds != GAP
    pipes = np.flatnonzero(data[1:] == 0x7C) + 1
    odd = np.unique(np.searchsorted(at, np.concatenate((np.flatnonzero(kinds == UNSURE), pipes[data[pipes - 1] == 0x3C])), side="right"))
    if len(odd):
        lower = np.frombuffer(raw.translate(LOWER), np.uint8).copy()
        for a, b in zip(at[odd - 1].tolist(), at[odd].tolist()):
            lower[a:b], begins[a:b] = data[a:b], begins[a:b] == 1
        letters = lower[inside].tobytes()
    else:
        letters = raw.translate(LOWER, GAPS)
    begin = np.flatnonzero(begins != 0)
    of = np.flatnonzero(begins.take(begin) == 3)
    ahead = kinds.take(begin[of]) == LEAD
    lead = begin[of] - 2 * ~ahead
    letter = data.take(lead + 1)
    begin = np.delete(begin, of[(data.take(lead) != 0xC3) | (letter == 0x97) | (letter == 0xB7)])
    starts = np.append(np.cumsum(inside, dtype=np.int32)[begin] - 1, len(letters))  # without gaps
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(letters))
    return words, np.diff(np.searchsorted(begin, at))


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of a column; a row of more is one alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def packed(docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> part, seq, n_ids, file: files in ascending order of doc_id by (part, seq).

    Every document ends with ``end_id``; null texts count as empty and are that id alone. Null doc_ids come first; rows that
    repeat a doc_id stand next to each other, in the order of a hash of their texts.
    A text of any length is in one file, which may then be longer than others. An empty table gives no file.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = word_ids(path), TaskContext.get().partitionId(), 0
        docs_, counts, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs_, counts, ids, held, seq
            all_ids = np.concatenate(ids)
            file = pack(docs_, np.concatenate(counts), all_ids)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "n_ids": pa.array([len(all_ids)], pa.int64()), "file": pa.array([file], pa.binary())})
            docs_, counts, ids, held, seq = [], [], [], 0, seq + 1
            return out

        for batch in batches:
            for piece in by_bytes(batch, "text", SLICE_BYTES):
                n, found = encode(piece.column("text"))
                ends = np.cumsum(n)
                found = np.insert(found, ends, end_id)
                docs_ += piece.column("doc_id").to_pylist()
                counts.append(n + 1)
                ids.append(found)
                held += len(found)
                if held >= file_ids:
                    yield flush()
        if docs_:
            yield flush()

    tuned(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "part long, seq long, n_ids long, file binary")


def starts(files: DataFrame) -> DataFrame:
    """part, seq, start: ids in files before. Sums by part come first, so that no task orders all files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return files.select("part", "seq", "n_ids").withColumn("within", within).join(before, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("start"))


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file"), batch.column("start"), strict=True):
                docs, counts, ids = unpack(file.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(ends - counts + start.as_py(), pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    placed = files.join(F.broadcast(starts(files)), ["part", "seq"])  # a row of 24 bytes for some million ids
    return placed.select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and the like: see ``packed``."""
    return digests(written(packed(documents(spark, sf_dir)), "tokens"))
