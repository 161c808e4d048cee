"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model, trained on all trusted text but a held-out part.

Counts: a word belongs to a shard by its hash. Chunks of trusted text send each shard the distinct pairs whose first word is its own,
with counts, and shards add them up. Discounts come from the counts of counts. The shard of a word then holds, as tables in the shared
folder: the pairs it begins, with their discounted share; the weight it leaves to the lower order; and its own share of that order, the
number of distinct words before it, which the shards of those words send.

Scoring: documents are cut into chunks of bounded size. A chunk asks each shard once for each of its distinct words and pairs, however
frequent; requests meet the shard's tables in a join by shard, and the answers meet the chunk in another. So no worker holds the model, a
hot word costs a request a chunk, and nothing is left out. Chunks are cut twice from the same reading, and a checksum tells if
that was not so. Shards know words by their shard and 32 bits more of a hash.

Threshold: a language's quantile of the perplexities of trusted documents that are never trained on, a fixed quarter of them by hash, from counts by bucket of the
logarithm, which merge by adding. A language's counts are topped up by those of all languages with the weight of ``TOP_UP``
documents, so that few trusted documents count for as much as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, forget, release, tuned, words_of, written
from .running import Texts, cut, packed, shard_bits, shard_edges, unpacked

#: Bytes of text of a chunk, about.
CHUNK = 32 << 20
QUANTILE, SLACK, TOP_UP = 0.99, 1.15, 20
#: The word before a text's first.
START = np.uint64(0x51A251A251A251A2)
#: Buckets to a unit of log perplexity.
BUCKETS = 200
#: Trusted documents that are broadcast at most; more are joined by sorting.
TRUST_ROWS = 4_000_000


class Pairs:
    """Distinct words of texts in the order of their hashes, and distinct pairs (word before, word) in the order of both."""

    def __init__(self, texts: Texts, some: np.ndarray | None = None):
        before = texts.before()
        before[texts.first] = START
        tokens = texts.tokens
        if some is not None:
            kept = np.repeat(some, texts.sizes)
            tokens, before = tokens[kept], before[kept]
        self.keys, index = np.unique(np.concatenate((tokens, [START])), return_inverse=True)
        self.word = index[:-1]
        start = int(index[-1])
        sizes = texts.sizes if some is None else texts.sizes[some]
        first = np.cumsum(sizes) - sizes
        self.before = np.empty(len(self.word), np.int64)
        self.before[1:] = self.word[:-1]
        self.before[first] = start
        self.all = (self.before << 32) | self.word


def word_prints(keys: np.ndarray, bits: int) -> np.ndarray:
    """32 bits of hashes below those that tell the shard."""
    return (keys >> np.uint64(32 - bits)).astype(np.uint32)


def rising(values: np.ndarray) -> bytes:
    """32-bit numbers, mostly in rising order, by their differences."""
    return packed(np.diff(values.astype(np.uint32), prepend=np.uint32(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint32)


def parts(keys: np.ndarray, pairs: np.ndarray, bits: int) -> Iterator[tuple[int, slice, slice]]:
    """shard, its words, and the pairs that they begin."""
    edges = shard_edges(keys, bits)
    at = np.searchsorted(pairs, edges.astype(np.int64) << 32)
    for s in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(s), slice(edges[s], edges[s + 1]), slice(at[s], at[s + 1])


REQUEST = "shard int, chunk long, words binary, follow binary, pairs binary, counts binary"


def asked(docs: DataFrame, bits: int, trusted: bool) -> DataFrame:
    """What chunks ask the shards for (``trusted``: what chunks of trusted text add): prints of its words, how many pairs each begins, the prints
    of those pairs' second words, and the pairs' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows, texts in cut(batches, ("learned",), CHUNK):
            p = Pairs(texts, np.array(rows["learned"], bool) if trusted else None)
            pairs, counts = np.unique(p.all, return_counts=True)
            second, follow = (p.keys[pairs & 0xFFFFFFFF] >> np.uint64(32)).astype(np.uint32), np.bincount(pairs >> 32, minlength=len(p.keys))
            prints = word_prints(p.keys, bits)
            found = list(parts(p.keys, pairs, bits))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in found], pa.int32()), pa.array([chunk] * len(found), pa.int64()), pa.array([rising(prints[w]) for _, w, _ in found], pa.binary()), pa.array([packed(follow[w]) for _, w, _ in found], pa.binary()), pa.array([rising(second[x]) for _, _, x in found], pa.binary()), pa.array([packed(counts[x]) if trusted else b"" for _, _, x in found], pa.binary())], ["shard", "chunk", "words", "follow", "pairs", "counts"])

    return docs.select("learned", "text").mapInArrow(run, REQUEST)


def joined(words: bytes, follow: bytes, pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Prints of words, and pairs as 64-bit numbers."""
    w = risen(words)
    return w, (np.repeat(w, unpacked(follow)).astype(np.uint64) << np.uint64(32)) | risen(pairs)


def counted(requests: DataFrame, second_shards: int) -> DataFrame:
    """By shard: its pairs and their counts, how many pairs have a count of 1 to 4; and, for the shards of second words (to), the number of
    distinct first words (n) of each."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, index = np.unique(np.concatenate([joined(r["words"], r["follow"], r["pairs"])[1] for r in rows]), return_inverse=True)
        n = np.bincount(index, np.concatenate([unpacked(r["counts"]) for r in rows])).astype(np.int64)
        seconds, firsts = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
        edges = np.searchsorted(seconds, np.arange(second_shards) << 32 >> (second_shards.bit_length() - 1))
        edges = np.append(edges, len(seconds))
        some = np.flatnonzero(edges[1:] > edges[:-1])
        to = [slice(edges[s], edges[s + 1]) for s in some]
        m, (words, follow) = len(to), np.unique((keys >> np.uint64(32)).astype(np.uint32), return_counts=True)
        return pa.table({
            "shard": pa.array([rows[0]["shard"]] * (m + 1), pa.int32()), "to": pa.array([None, *some], pa.int32()), "words": pa.array([rising(words)] + [None] * m, pa.binary()),
            "follow": pa.array([packed(follow)] + [None] * m, pa.binary()), "keys": pa.array([rising((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)), *(rising(seconds[x]) for x in to)], pa.binary()),
            "n": pa.array([packed(np.minimum(n, (1 << 32) - 1)), *(packed(firsts[x]) for x in to)], pa.binary()),
            "of": pa.array([[int((n == k).sum()) for k in (1, 2, 3, 4)]] + [None] * m, pa.list_(pa.int64())),
        })

    return requests.groupBy("shard").applyInArrow(run, "shard int, to int, words binary, follow binary, keys binary, n binary, of array<long>")


def discounts(of: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = of
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return np.array([0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))])


def continuations(sent: DataFrame) -> DataFrame:
    """By shard of second words: their prints, the number of distinct first words, its sum and counts of counts 1 to 4."""

    def run(table: pa.Table) -> pa.Table:
        keys, index = np.unique(np.concatenate([risen(k.as_py()) for k in table.column("keys")]), return_inverse=True)
        n = np.bincount(index, np.concatenate([unpacked(x.as_py()) for x in table.column("n")])).astype(np.int64)
        return pa.table({"shard": table.column("to")[:1], "keys": pa.array([rising(keys)], pa.binary()), "n": pa.array([packed(n)], pa.binary()), "of": pa.array([[*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n), int(n.sum())]], pa.list_(pa.int64()))})

    return sent.groupBy("to").applyInArrow(run, "shard int, keys binary, n binary, of array<long>")


def sums(of: DataFrame, size: int) -> list[int]:
    row = of.agg(*[F.coalesce(F.sum(F.get("of", F.lit(i))), F.lit(0)).alias(str(i)) for i in range(size)]).first()
    return [int(x) for x in row]


class Model:
    """Tables by shard: of pairs with counts, and of second words with theirs; discounts of both; distinct words and pairs."""

    def __init__(self, pairs: DataFrame, words: DataFrame, bits: int):
        self.pairs, self.words, self.bits = pairs, words, bits
        self.d2 = discounts(sums(pairs, 4))
        *of, self.types, self.n_pairs = sums(words, 6)
        self.d1 = discounts(of)
        # what the lower order leaves to words never seen, as one more word
        held = words.select(F.get("of", F.lit(0)).alias("a"), F.get("of", F.lit(1)).alias("b"), F.get("of", F.lit(4)).alias("all")).agg(F.sum("a"), F.sum("b"), F.sum("all")).first()
        a, b, n = (int(x or 0) for x in held)
        self.root = float(self.d1[1] * a + self.d1[2] * b + self.d1[3] * (n - a - b)) / max(1, self.n_pairs) / (self.types + 1)


def train(docs: DataFrame, bits: int) -> Model | None:
    """Model of the documents with ``learned``; None without any."""
    found = written(counted(asked(docs, bits, True), 1 << bits), "pairs")
    words = written(continuations(found.where("to IS NOT NULL")), "words")
    pairs = found.where("to IS NULL").select("shard", "words", "follow", "keys", "n", "of")
    pairs._tidemark_path = found._tidemark_path
    model = Model(pairs, words, bits)
    del found
    release(docs.sparkSession)
    return model if model.types else None


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


def answered(requests: DataFrame, model: Model) -> DataFrame:
    """chunk, shard, and for what it asked for: shares of pairs, weights (float16) that words leave to the lower order, and the words' counts there."""
    d2, bits = model.d2, model.bits

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {r["kind"]: r for r in right.to_pylist()}
        pairs, n = (joined(held[2]["words"], held[2]["follow"], held[2]["keys"])[1], unpacked(held[2]["n"]).astype(np.int64)) if 2 in held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        first = (pairs >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.empty(0, np.int64)
        off = d2[np.minimum(n, 3)]
        total = np.add.reduceat(n, begin) if len(begin) else n
        weight = np.add.reduceat(off, begin) / total if len(begin) else off
        share = (n - off) / np.repeat(total, np.diff(np.append(begin, len(first))))
        seconds, m = (risen(held[1]["keys"]), unpacked(held[1]["n"])) if 1 in held else (np.empty(0, np.uint32), np.empty(0, np.uint32))
        out = {"shares": [], "weights": [], "n": []}
        for r in left.to_pylist():
            w, p = joined(r["words"], r["follow"], r["pairs"])
            out["shares"].append(packed(looked_up(pairs, np.maximum(share, 6e-8).astype(np.float16).view(np.uint16), p)))
            out["weights"].append(packed(looked_up(first[begin], np.maximum(weight, 6e-8).astype(np.float16).view(np.uint16), w)))
            # second words are known by the upper 32 bits of their hashes
            upper = ((np.uint64(r["shard"]) << np.uint64(32)) | w.astype(np.uint64)) >> np.uint64(bits)
            out["n"].append(packed(looked_up(seconds, m, upper.astype(np.uint32))))
        return pa.table({"chunk": left.column("chunk"), "shard": left.column("shard")} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    tables = model.pairs.select("shard", F.lit(2).alias("kind"), "words", "follow", "keys", "n").unionByName(model.words.select("shard", F.lit(1).alias("kind"), "keys", "n"), allowMissingColumns=True)
    return requests.drop("counts").groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(run, "chunk long, shard int, shares binary, weights binary, n binary")


def bodies(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, langs, sizes, tokens (indexes of words in the order of their hashes), types, start (index of the word before the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows, texts in cut(batches, ("doc_id", "lang"), CHUNK):
            p = Pairs(texts)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "doc_ids": pa.array([rows["doc_id"]], pa.list_(pa.int64())), "langs": pa.array([rows["lang"]], pa.list_(pa.string())), "sizes": pa.array([texts.sizes], pa.list_(pa.int64())), "tokens": pa.array([packed(p.word)], pa.binary()), "types": pa.array([len(p.keys)], pa.int64()), "start": pa.array([int(np.searchsorted(p.keys, START))], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "chunk long, doc_ids array<long>, langs array<string>, sizes array<long>, tokens binary, types long, start long")


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_tokens, log_perplexity (natural, per token)."""
    d1, root, n_pairs = model.d1, model.root, max(1, model.n_pairs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, answers = left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: r["shard"])
        word, sizes = unpacked(row["tokens"]).astype(np.int64), np.array(row["sizes"])
        first = np.cumsum(sizes) - sizes
        before = np.empty(len(word), np.int64)
        before[1:], before[first] = word[:-1], row["start"]
        pairs, at = np.unique((before << 32) | word, return_inverse=True)
        share, weight, n = (np.concatenate([unpacked(r[c]) for r in answers]) for c in ("shares", "weights", "n"))
        if len(left) != 1 or len(share) != len(pairs) or len(n) != row["types"]:
            raise ValueError("chunks were cut in another way at a second reading: write the table before scoring it")
        share, weight = (x.astype(np.uint16).view(np.float16).astype(np.float64) for x in (share, weight))
        lower = (n - d1[np.minimum(n, 3)]) / n_pairs + root
        weight[weight == 0] = 1.0  # a word that begins no pair leaves all to the lower order
        score = np.add.reduceat(np.log(share[at] + weight[before] * lower[word]), first)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "n_tokens": pa.array(sizes), "log_perplexity": pa.array(-score / sizes)})

    # in two steps: what was asked for need not stay on disk while chunks meet their answers
    answers = written(answered(asked(docs, model.bits, False), model), "answers")
    release(docs.sparkSession)
    scored = written(bodies(docs).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "doc_id long, lang string, n_tokens long, log_perplexity double"), "scored")
    forget(answers)
    return scored


def flagged(docs: DataFrame, good: DataFrame) -> DataFrame:
    """``docs`` with learned: whether a document is trusted and not of the part that sets the threshold. The list of trusted documents is
    broadcast if it was counted to be small; else it is joined by sorting, and the table is written so that it reads alike twice."""
    few = good.count() <= TRUST_ROWS
    marks = good.where(in_training()).select("doc_id", F.lit(True).alias("learned"))
    out = docs.select("doc_id", "lang", "text").join(F.broadcast(marks) if few else marks, "doc_id", "left").withColumn("learned", F.coalesce("learned", F.lit(False)))
    return out if few else written(out, "flagged")


def in_training():
    return F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) != 0


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality; trusted are those with 1) -> a row per row: doc_id, lang, n_tokens,
    perplexity, threshold, kept.

    Null texts are an end alone. A null language is a language. Rows that repeat a doc_id or a text are counted and scored each; texts may be
    of any length. Without trusted text nothing can be told: perplexity and threshold are null, and all are kept; without held-out trusted
    text the threshold is null. A document is kept up to ``slack`` times its language's quantile, that included. An empty table gives an
    empty result. ``docs`` must read the same rows in the same order twice, as a stored table does; otherwise an error says so.
    """
    tuned(docs.sparkSession)
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marked = flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), good)
    model = train(marked, shard_bits(docs))
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), (F.size(words_of(F.col("text"))) + 1).cast("long").alias("n_tokens"), nothing.alias("perplexity"), nothing.alias("threshold"), F.lit(True).alias("kept"))
    scored = perplexities(marked, model)
    forget(model.pairs, model.words)
    held_out = scored.join(good.where(~in_training()), "doc_id", "left_semi")
    counts = written(held_out.groupBy("lang", F.floor(F.col("log_perplexity") * BUCKETS).alias("bucket")).agg(F.count("*").alias("n")), "buckets")
    # the buckets of all languages together: some thousand at most, since logarithms of perplexities are small numbers
    whole = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    shares = json.dumps([{"bucket": b, "n": n * TOP_UP / sum(whole.values())} for b, n in sorted(whole.items())])
    every = F.explode(F.from_json(F.lit(shares), "array<struct<bucket: long, n: double>>"))
    topped = scored.select("lang").distinct().select("lang", every.alias("w")).select("lang", "w.bucket", "w.n").union(counts.select("lang", "bucket", F.col("n").cast("double"))).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    of = W.partitionBy("lang")
    ranked = topped.withColumn("upto", F.sum("n").over(of.orderBy("bucket"))).withColumn("all", F.sum("n").over(of))
    limits = written(ranked.groupBy("lang").agg(F.min(F.when(F.col("upto") >= quantile * F.col("all") - 1e-9, F.col("bucket") + 1)).alias("bucket")).select(F.col("lang").alias("l"), "bucket"), "limits")
    out = scored.join(limits, F.expr("lang <=> l"), "left")
    threshold = F.exp(F.col("bucket") / BUCKETS) * slack
    return out.select("doc_id", "lang", "n_tokens", F.exp("log_perplexity").alias("perplexity"), threshold.alias("threshold"), F.coalesce(F.exp("log_perplexity") <= threshold, F.lit(True)).alias("kept"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, empty texts and the like: see ``quality``."""
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
