"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For a pre-token of n symbols an automaton over the vocabulary reports, at each end position, the vocabulary tokens that are
suffixes of the prefix. Exactly one of them is the last token of the prefix's encoding: the one that is compatible with the
last token of what stands before it, that is, no merge of lower rank would have joined across their border. Last tokens of
all prefixes are kept, and following them back from the end gives the ids, without a merge queue.

The vocabulary file is read where the work is done, by a path that is a parameter; every machine has the tokenizer files.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import documents, tuned

VOCABULARY = "word_bpe_49k.json"
#: Pairs of tokens, and bytes of words and of pre-tokens, that a worker remembers; beyond that it starts anew. Longer words are not remembered.
MEMORY, MEMORY_BYTES, LONG_WORD = 400_000, 96 << 20, 64
#: What makes a word's last symbol another symbol than the same letter inside a word.
LAST = 0x1000
#: Beyond this code point, letters, digits and white space differ between the Unicode versions in use; up to it nothing composes.
FAR = re.compile("[^\x00-\u024f]")
#: Letters that stand for themselves in the byte-level alphabet.
PLAIN = re.compile("[!-~]*")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter for each byte of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PrefixBpe:
    """Encoder for a vocabulary file whose tokens end words with a suffix. ``encode`` gives the ids that the file's own library gives."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.digits = {i: str(i) for i in self.tokens}
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pretoken = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = byte_letters()
        vocab = model["vocab"]
        self.rank = {}  # of a token: when merging makes it; single symbols come first
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for r, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((left, right), r)
            if whole not in self.halves:
                self.halves[whole] = (left, right)
                self.rank[whole] = r
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if symbols := self.symbols_of(token):
                self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.spelt = Spelt(self)
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_bytes = 0
        self.fits: dict[int, bool] = {}

    def symbols_of(self, token: str) -> str:
        if not token.endswith(self.suffix):
            return token
        body = token[: -len(self.suffix)]
        return body[:-1] + chr(ord(body[-1]) + LAST) if body else ""

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when the text of both is encoded: taking the later-made of the two apart again
        and again, no pair that meets at the border may have a merge that would have come before the parts were joined."""
        key, end = a << 16 | b, len(self.merged)
        until, ok = end, None
        while ok is None:
            if self.merged.get((a, b), end) < until:
                ok = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                ok = True
            elif ra > rb:  # a was made last: before that its right half stood at the border
                until, a = ra, self.halves[a][1]
            else:  # merges of one rank go from left to right: the border's comes before the one that makes b
                until, b = rb + 1, self.halves[b][0]
        if len(self.fits) > MEMORY:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def lettered(self, text: str) -> str:
        letters = self.letters
        return "".join([letters[x] for x in text.encode()])

    def encode_pretoken(self, text: str) -> tuple[int, ...]:
        """``text``: a pre-token in the byte-level alphabet."""
        if (found := self.known.get(text)) is not None:
            return found
        symbols = text[:-1] + chr(ord(text[-1]) + LAST)
        last, lengths = [0] * len(symbols), [0] * len(symbols)
        fits, compatible = self.fits.get, self.compatible
        done = -1
        for end, (length, token) in self.automaton.iter(symbols):  # at each end, longest first
            if end == done:
                continue
            before = end - length
            if before >= 0:
                a = last[before]
                if (ok := fits(a << 16 | token)) is None:
                    ok = compatible(a, token)
                if not ok:
                    continue
            last[end], lengths[end] = token, length
            done = end
        ids, at = [], len(symbols) - 1
        while at >= 0:
            ids.append(last[at])
            at -= lengths[at]
        out = tuple(reversed(ids))
        if len(text) <= LONG_WORD:
            if self.known_bytes > MEMORY_BYTES // 2:
                self.known.clear()
                self.known_bytes = 0
            self.known_bytes += 180 + 2 * len(text) + 8 * len(out)
            self.known[text] = out
        return out

    def pretokens(self, part: str) -> list[str]:
        """Pre-tokens of a normalised text without specials, in the byte-level alphabet."""
        pieces = self.pretoken.findall(part)
        return pieces if PLAIN.fullmatch(part) else [self.lettered(x) for x in pieces]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not FAR.search(part):
                pieces = self.pretokens(part.lower())
            else:  # letters of which Unicode's versions tell differently are told by the library
                pieces = [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
            for piece in pieces:
                ids.extend(self.encode_pretoken(piece))
        return ids

    def decode(self, ids) -> str:
        """As the library does without a decoder: the tokens' strings, joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def forget(self) -> None:
        for kept in (self.spelt, self.known, self.fits):
            kept.clear()
        self.known_bytes = self.spelt.held = 0

    def document(self, text: str) -> tuple[int, str, str]:
        """Count of ids, decimal ids joined by spaces, and decoded text. A text is taken by what stands between white space: no
        token reaches over it. In lower case, words that differ in capitals only are one."""
        if "<|" in text or FAR.search(text) or CONTROLS.search(text):
            words = [w for w in OTHER_GAPS.sub(" ", text).split(" ") if w]  # other white space is left to the pre-token pattern
        else:
            words = text.lower().split()
        if not words:
            return 0, "", ""
        spelt = list(map(self.spelt.__getitem__, words))
        if self.spelt.gaps:  # words of which nothing is left
            spelt = [x for x in spelt if x[0]] or [("", "")]
        ids, decoded = map(" ".join, zip(*spelt, strict=True))
        return ids.count(" ") + 1 if ids else 0, ids, decoded


class Spelt(dict):
    """Decimal ids and decoded text of a word, by the word."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe, self.gaps, self.held = bpe, False, 0

    def __missing__(self, word: str) -> tuple[str, str]:
        ids = self.bpe.encode(word)
        if not ids:
            self.gaps = True
        digits = self.bpe.digits
        found = " ".join([digits[i] for i in ids]), self.bpe.decode(ids)
        if len(word) <= LONG_WORD:
            if self.held > MEMORY_BYTES:
                self.clear()
                self.held = 0
            self.held += 350 + 4 * (len(word) + len(found[1])) + len(found[0])
            self[word] = found
        return found


OTHER_GAPS = re.compile("[\t\n\x0b\f\r]+")
#: What ``str.split`` takes for white space and the pre-token pattern does not.
CONTROLS = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBpe:
    return PrefixBpe(path)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> a row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    with ``with_ids`` also ids array<int>. Null text counts as empty and has no ids; repeated rows and equal texts are encoded alike. A text of any
    length is encoded whole, word by word. An empty table gives an empty result."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            n, ids, decoded, lists = [], [], [], []
            for text in batch.column("text"):
                count, spelt, back = bpe.document(text.as_py() or "")
                n.append(count)
                ids.append(hashlib.sha256(spelt.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    lists.append(np.fromstring(spelt, np.int32, sep=" "))
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)
        bpe.forget()  # workers outlive tasks, and other stages need the memory

    tuned(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS + ", ids array<int>" * with_ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and the like: see ``encode``."""
    return encode(documents(spark, sf_dir))
