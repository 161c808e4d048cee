"""Telephony audio columns: mu-law, A-law and IMA ADPCM samples in RIFF files, expanded and resampled to 16-bit PCM.

The eight-bit codes are expanded by 256-entry lookup tables made from the G.711 rules. ADPCM is sequential inside a block only:
all blocks of a batch are decoded together, one numpy step per sample position, with the step's difference and the next table
index taken from 89 x 16 tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, tuned, written

UNIT, FILL, RATE = 576, b"\xff", 8000
#: RIFF format tags.
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: Bytes of an ADPCM block: predictor (2), index (1), reserved (1), then two samples a byte.
BLOCK = 36
#: Payload bytes that are decoded together.
TOGETHER = 2 << 20

# Fixed values of IMA ADPCM.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    t = (((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)
    return np.where(u & 0x80, 0x84 - t, t - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    t, segment = (a & 0x0F) << 4, (a & 0x70) >> 4
    t = np.where(segment == 0, t + 8, (t + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, t, -t).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By index * 16 + code: the difference, and the next index * 16."""
    code, step = np.arange(16), STEPS[:, None]
    diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -diff, diff).astype(np.int32).ravel(), following.astype(np.int32).ravel()


MULAW, ALAW = mulaw_table(), alaw_table()
DIFFERENCE, FOLLOWING = adpcm_tables()


def adpcm_decode(data: bytes | np.ndarray) -> np.ndarray:
    """int16 samples (blocks, samples of a block); data: whole blocks. A stored index beyond the table counts as its end."""
    blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    out = np.empty((2 * (BLOCK - 4), len(blocks)), np.int16)
    for j in range(4, BLOCK):
        byte = np.ascontiguousarray(blocks[:, j])
        for half, code in enumerate((byte & 15, byte >> 4)):
            key = at + code
            value += DIFFERENCE.take(key)
            np.clip(value, -32768, 32767, out=value)
            at = FOLLOWING.take(key)
            out[2 * (j - 4) + half] = value
    return out.T


def resample_double(x: np.ndarray) -> np.ndarray:
    """Twice the rate: samples, and between two of them the four-point cubic, edges repeated."""
    p = np.empty(len(x) + 3, np.int32)
    p[1:-2] = x
    p[0], p[-2:] = x[0], x[-1]
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    middle = (9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4
    out[1::2] = np.clip(middle, -32768, 32767, out=middle)
    return out


def to_riff(payload: bytes, samples: int, codec: str = "mulaw") -> bytes:
    """A RIFF file of one channel at 8 kHz; ``samples``, in the fact chunk, says how many count."""
    align = BLOCK if codec == "adpcm" else 1
    rate = RATE if align == 1 else RATE * BLOCK // (2 * (BLOCK - 4))
    fmt = struct.pack("<4sIHHIIHHH", b"fmt ", 18, CODECS[codec], 1, RATE, rate, align, 4 if codec == "adpcm" else 8, 0)
    body = b"".join((b"WAVE", fmt, struct.pack("<4sII", b"fact", 4, samples), struct.pack("<4sI", b"data", len(payload)), payload, b"\0" * (len(payload) % 2)))
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_riff(media: bytes) -> tuple[str, int, memoryview]:
    """Codec, samples that count, and payload."""
    view, at, found = memoryview(media), 12, {}
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    while at + 8 <= len(view):
        name, size = struct.unpack_from("<4sI", view, at)
        found[name] = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag = struct.unpack_from("<H", found[b"fmt "])[0]
    return next(k for k, v in CODECS.items() if v == tag), struct.unpack("<I", found[b"fact"])[0], found[b"data"]


def to_pcm(media: bytes) -> np.ndarray:
    """Samples at 16 kHz of a stored file of any of the codecs."""
    codec, _, payload = from_riff(media)
    codes = np.frombuffer(payload, np.uint8)
    return resample_double(adpcm_decode(codes).ravel() if codec == "adpcm" else (MULAW if codec == "mulaw" else ALAW)[codes])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + FILL * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def stored(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id, media: each text's bytes as samples of a RIFF file. A null
    text counts as empty and is one unit of filling; repeated rows are stored alike, and so are equal texts. A text of any length is one
    file. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_riff(payload, n, codec) for n, payload in map(padded, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "media": pa.array(media, pa.binary())})

    tuned(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def pcm(media: DataFrame) -> DataFrame:
    """doc_id, media -> doc_id, rate, pcm: little-endian 16-bit samples at 16 kHz, of whatever codec a file has. ``stored_pcm`` writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [to_pcm(m.as_py()).astype("<i2").tobytes() for m in batch.column("media")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "rate": pa.array([2 * RATE] * len(out), pa.int32()), "pcm": pa.array(out, pa.binary())})

    return media.mapInArrow(run, "doc_id long, rate int, pcm binary")


def stored_pcm(media: DataFrame) -> DataFrame:
    """The column of ``pcm`` written as a table in the shared folder, and read again: four bytes for each of the media's."""
    return written(pcm(media), "pcm")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(payloads: list[memoryview]) -> list[str]:
    """For each payload: samples, energy and zero crossings of its mu-law samples, energy of the same bytes as A-law and as
    ADPCM, peak of the latter, and the CRC of its samples at 16 kHz."""
    codes = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    starts = np.cumsum(sizes) - sizes
    mu = MULAW[codes]
    energy = {k: np.add.reduceat(SQUARES[k][codes], starts) for k in SQUARES}
    crossed = np.zeros(len(mu), np.int64)
    crossed[1:] = (mu[1:] ^ mu[:-1]) < 0
    crossed[starts] = 0
    crossings = np.add.reduceat(crossed, starts)
    decoded = adpcm_decode(codes).astype(np.int64)
    blocks = starts // BLOCK
    adpcm = np.add.reduceat((decoded * decoded).sum(axis=1), blocks)
    peak = np.maximum.reduceat(np.abs(decoded).max(axis=1), blocks)
    out = []
    for i, (at, n) in enumerate(zip(starts, sizes, strict=True)):
        crc = zlib.crc32(resample_double(mu[at : at + n]).astype("<i2", copy=False))
        out.append(f"samples={n};mulaw={energy['mulaw'][i]};crossings={crossings[i]};alaw={energy['alaw'][i]};adpcm={adpcm[i]};peak={peak[i]};pcm16k={crc:08x}")
    return out


SQUARES = {"mulaw": MULAW.astype(np.int64) ** 2, "alaw": ALAW.astype(np.int64) ** 2}


def digests(media: DataFrame) -> DataFrame:
    """doc_id, media -> the columns of DIGESTS, from what the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            read = [from_riff(m)[1:] for m in files]
            found, group, size = [], [], 0
            for _, payload in read:
                group.append(payload)
                size += len(payload)
                if size >= TOGETHER:
                    found += features(group)
                    group, size = [], 0
            if group:
                found += features(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in read], pa.int64()), pa.array([len(p) for _, p in read], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for _, p in read]), pa.array([zlib.crc32(p[-32:]) for _, p in read], pa.int64()), pa.array([len(m) for m in files], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in files]), pa.array(found, pa.string())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, DIGESTS)


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are written and read back; of the resampled samples a digest is kept. Nulls and the like: see ``stored``."""
    return digests(written(stored(documents(spark, sf_dir)), "media"))
