"""Toxicity by a weighted lexicon of word beginnings, and words, matched by Aho-Corasick over folded text.

Folding brings look-alike letters, digits used as letters and letters of one shape (i, l, 1, |) together, so that a disguised
word meets its entry. The lexicon and its weights are learned from a bounded sample of labels: candidates are words and beginnings of words
in toxic documents, chosen greedily by how many toxic documents they cover beyond those already covered, less the clean ones they
hit; words that are frequent in toxic documents and in no clean one follow.
An entry's weight is its log-odds. A document's sum of weights is divided by a slow function of its length and turned into a
probability by a fitted logistic curve. Hits inside exception phrases do not count: these are learned too, two-word phrases around an entry that clean
documents have again and again and toxic ones never; more can be given.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tuned, written

#: Labelled rows to learn from, at most: those first by a hash of their doc_id.
SAMPLE = 20_000
#: Letters of beginnings; longer entries are whole words.
LENGTHS = range(3, 13)
#: Clean documents that a phrase must stand in to be an exception.
EXCEPTION_DOCS = 3
PREDICT_AT = 0.7

# Letters that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = str.maketrans("абеорсухіјѕԁһӏкмтвнαορνικτυχ", "abeopcyxijsdhlkmtbhaopvlktux")
STAND_INS = str.maketrans("0134578@$!|l", "oieastbasiii")
TOKEN = re.compile(r"(?:[^\W_]|(?<=[^\W_])[@$!|](?=[^\W_]))+")


def fold(text: str | None) -> list[str]:
    """Folded words of a text; numbers stay as they are."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(LOOK_ALIKES)
    return [w if w.isdigit() else w.translate(STAND_INS) for w in TOKEN.findall(text)]


def beginnings(words: list[str]) -> set[str]:
    """Candidates of a text: beginnings of its words, and its words, which end in a space."""
    words = set(words)
    return {w[:k] for w in words for k in LENGTHS if len(w) >= k} | {w + " " for w in words if len(w) >= 3}


class Lexicon:
    """Entries with weights, exception phrases, and the curve from a document's sum to its score."""

    def __init__(self, weights: dict[str, float], exceptions=(), slope: float = 1.0, offset: float = -1.0):
        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
        """Entries, and exception phrases, with their places in the words joined by spaces."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                folded = f" {' '.join(fold(phrase))} "
                self.automaton.add_word(folded, (len(folded), None, True))
            for entry in self.weights:  # an entry begins a word
                key = f" {entry}"
                self.automaton.add_word(key, (len(key), entry, self.automaton.exists(key)))
            self.automaton.make_automaton()
        found, spans = [], []
        for end, (length, entry, phrase) in self.automaton.iter(f" {' '.join(words)} "):
            if entry is not None:
                found.append((end - length + 1, end, entry))
            if phrase:
                spans.append((end - length + 1, end))
        return found, spans

    def strength(self, text: str | None) -> float:
        """Sum of the weights of what is hit, divided by a slow function of the length. 0 without a hit."""
        if not self.weights:
            return 0.0
        words = fold(text)
        hits, spans = self.hits(words)
        if not hits:
            return 0.0
        found = Counter(e for a, b, e in outside(hits, spans))
        total = sum(self.weights[e] * (1 + math.log(n)) for e, n in sorted(found.items()))
        return total / math.log(math.e + len(words) / 1000)

    def phrases(self, text: str | None) -> set[str]:
        """Pairs of a word with an entry in it and the word before or after it."""
        words, out = fold(text), set()
        begin, at = {}, 0
        for i, w in enumerate(words):
            begin[at] = i  # where the space before the word stands
            at += len(w) + 1
        for a, _, _ in self.hits(words)[0]:
            i = begin[a]
            out |= {" ".join(words[x : x + 2]) for x in (i - 1, i) if x >= 0 and x + 2 <= len(words)}
        return out

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.strength(text) + self.offset))))


def outside(hits: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Hits that lie within no span: both in the order of their beginnings, with the furthest end of the spans begun so far."""
    spans, out, reached, k = sorted(spans), [], -1, 0
    for a, b, e in sorted(hits):
        while k < len(spans) and spans[k][0] <= a:
            reached, k = max(reached, spans[k][1]), k + 1
        if b > reached:
            out.append((a, b, e))
    return out


LEAST_ODDS = math.log(10)


def odds_of(toxic: int, n_toxic: int, clean: int, n_clean: int) -> float:
    """Log-odds of an entry in so many of the toxic and of the clean documents."""
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def chosen(toxic: list[set[str]], clean_hits: dict[str, int], n_clean: int, least: int) -> dict[str, float]:
    """Entries and weights: greedily those that cover most toxic documents not yet covered, less clean ones hit; of equals the longest."""
    by: dict[str, set[int]] = {}
    for i, found in enumerate(toxic):
        for c in found:
            by.setdefault(c, set()).add(i)
    total, open_, out = len(toxic), set(range(len(toxic))), {}
    ratio = max(1.0, n_clean / max(1, total))
    # one entry must be much likelier in toxic documents than in clean ones
    odds = {c: odds_of(len(d), total, clean_hits.get(c, 0), n_clean) for c, d in by.items()}
    live = [c for c in by if odds[c] > LEAST_ODDS]
    while open_ and live:
        gain = {c: len(by[c] & open_) - 2 * clean_hits.get(c, 0) / ratio for c in live}
        best = max(live, key=lambda c: (gain[c], len(c), c))
        if gain[best] < least:
            break
        out[best] = odds[best]
        open_ -= by[best]
        live = [c for c in live if gain[c] >= least and c != best]
    out.update({c: odds[c] for c, d in by.items() if c.endswith(" ") and len(d) >= max(5, 2 * least) and not clean_hits.get(c) and odds[c] > LEAST_ODDS})
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y) = 1 / (1 + exp(-(slope x + offset))), by Newton's method with a weak prior; classes weigh alike."""
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    theta, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (w * (p - y)) + np.array([1e-2, 1e-3]) * theta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, exceptions=(), sample: int = SAMPLE) -> Lexicon:
    """From ``labels`` (doc_id, toxic) of documents, at most ``sample`` of them, and ``exceptions`` that are known already; null labels are
    left out, and of several for one doc_id the highest holds. Rows that repeat a doc_id are learned from each. Of candidates that cover as much the longest, then the last by
    letters, is chosen. Without toxic labels the lexicon is empty and all scores are low; so it is for empty tables."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = written(known, "labels")  # at most ``sample`` rows of 12 bytes: bounded, so broadcast
    rows = written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "labelled")

    def toxic_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update(beginnings(fold(text.as_py())))
        yield pa.RecordBatch.from_pydict({"entry": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    counts = rows.groupBy("toxic").count().collect()
    n_toxic, n_clean = (sum(r["count"] for r in counts if (r["toxic"] > 0) == x) for x in (True, False))
    least = max(3, math.ceil(n_toxic / 200))
    counted = {r["entry"]: r["n"] for r in rows.where("toxic > 0").select("text").mapInArrow(toxic_beginnings, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(counted))

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update(beginnings(fold(text.as_py())) & shared.value)
        yield pa.RecordBatch.from_pydict({"entry": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    def toxic_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sorted(beginnings(fold(t.as_py())) & shared.value) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "entries": pa.array(out, pa.list_(pa.string()))})

    hits = {r["entry"]: r["n"] for r in rows.where("toxic <= 0").select("text").mapInArrow(clean_counts, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    # only what is much likelier in toxic documents goes on
    candidates = [c for c, n in counted.items() if odds_of(n, n_toxic, hits.get(c, 0), n_clean) > LEAST_ODDS]
    shared.unpersist()
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))
    # sets of the sample's toxic documents, over the candidates only
    sets = [set(r["entries"]) for r in rows.where("toxic > 0").select("doc_id", "text").mapInArrow(toxic_sets, "doc_id long, entries array<string>").orderBy("doc_id").collect()]
    weights = chosen(sets, hits, n_clean, max(2, least // 2))
    plain = rows.sparkSession.sparkContext.broadcast(Lexicon(weights))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found.update((p, toxic > 0) for p in plain.value.phrases(text))
        yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in found], pa.string()), "toxic": pa.array([t for _, t in found], pa.bool_()), "n": pa.array(found.values(), pa.int64())})

    if weights:
        by = rows.select("text", "toxic").mapInArrow(phrases, "phrase string, toxic boolean, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("good"))
        exceptions = sorted({*exceptions, *(r["phrase"] for r in by.where(f"bad = 0 AND good >= {EXCEPTION_DOCS}").select("phrase").collect())})
    plain.unpersist()
    lexicon = Lexicon(weights, tuple(exceptions))
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([held.value.strength(t.as_py()) for t in batch.column("text")], pa.float64()), "toxic": batch.column("toxic")})

    curve = rows.select("text", "toxic").mapInArrow(strengths, "x double, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    if lexicon.weights:
        x, y = (np.repeat(np.array([r[c] for r in curve], float), [r["count"] for r in curve]) for c in ("x", "toxic"))
        slope, offset = logistic(x, (y > 0).astype(float))
        lexicon.slope, lexicon.offset = max(slope, 0.0), offset
    else:
        lexicon.offset = math.log((n_toxic + 0.5) / (n_clean + 1.0)) if n_toxic + n_clean else -1.0
    shared.unpersist()
    held.unpersist()
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> a row per row: doc_id, score. Null texts count as empty and score as
    texts without a hit do. Equal texts score alike, repeated rows each; a text may be of any length. An empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "score": pa.array([held.value.score(t.as_py()) for t in batch.column("text")], pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels that are not held out. Nulls and the like: see ``learn`` and ``scored``."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


__all__ = ["Lexicon", "fold", "learn", "scored", "op7_toxicity", "tuned"]
