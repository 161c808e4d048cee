"""How far sources of a language differ in their terms: total differences of smoothed shares between sources, and each source's own terms.

Counts of (language, source, term) come from one pass over the texts, added up in tasks before they are shuffled. The kept terms of a
language are dealt into blocks by a hash. A block is a tile: a dense int64 matrix of all the language's sources by the block's terms, of
some ``TILE_CELLS`` cells, or up to eight times as many so that a tile has no more pairs than cells. In a tile numpy compares every source with all others at once; what
comes out is a partial sum for every pair, which Spark adds up over blocks, and for every source a heap of the tile's best terms, which a
ranking merges. No row of the texts, and no pair of terms, is ever shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, written

#: Bytes of terms: ASCII letters, and all of what is not ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCS, BEST = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
TILE_CELLS = 1 << 18
FEW_LANGUAGES = 100_000
#: Counts held by a task before they are handed on; handed on or not, they are added up after the shuffle.
MOST_HELD = 400_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches):
    """Rows of texts -> lang, source, term, n, docs, and for each group of a task a row of the empty term."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed_on():
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                spelt = pa.array(part, pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), spelt, pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)

    for batch in batches:
        columns = (batch.column(c) for c in ("lang", "source", "text"))
        for lang, source, text in zip(*columns):
            group = lang.as_py(), source.as_py()
            if group not in found:
                found[group] = Counter({b"": 0}), Counter({b"": 0})
                held += 1
            n, docs = found[group]
            terms = TERM.findall(text.as_py().encode().lower())  # of bytes, lower() touches A-Z only
            held -= len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held > MOST_HELD:
                yield from handed_on()
                found, held = {}, 0
    yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, source; null: empty) -> lang, source, term, n (occurrences), docs (documents with it). A group without terms has
    the empty term, with zeros, as every group."""
    hole = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(hole("lang"), hole("source"), hole("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 5) / (total + 5 * kept)), in three steps of 1000 so that int64 holds all but a total of 9 * 10**15."""
    of = total + SMOOTH * kept
    whole, rest = np.divmod(n + SMOOTH, of)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + more
    return whole + 1


def _tile(key, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Terms (source, term, n) of a block of a language, and its sources (source, total, kept) -> partial sums of pairs (a < b), best terms."""
    lang = key[0]
    groups = groups.sort_values("source", key=lambda s: s.str.encode("utf-8"))
    names, total, kept = groups["source"].to_numpy(object), groups["total"].to_numpy(np.int64), int(groups["kept"].iloc[0])
    row = {s: i for i, s in enumerate(names)}
    spelt = sorted(set(terms["term"]), key=lambda t: t.encode("utf-8"))
    column = {t: j for j, t in enumerate(spelt)}
    n = np.zeros((len(names), len(spelt)), np.int64)
    n[[row[s] for s in terms["source"]], [column[t] for t in terms["term"]]] = terms["n"].to_numpy(np.int64)
    out = []
    if spelt:
        p = shares(n, total[:, None], kept)
        whole = shares(n.sum(axis=0), total.sum(), kept)
        for i in range(len(names)):
            above = np.flatnonzero((n[i] > 0) & (p[i] > whole))
            value = p[i, above] - whole[above]
            best = heapq.nsmallest(BEST, zip((-value).tolist(), above.tolist()))  # terms' numbers are in the order of their bytes
            out += [(lang, names[i], "term", spelt[j], -v) for v, j in best]
    for i in range(len(names) - 1):
        apart = np.abs(p[i] - p[i + 1 :]).sum(axis=1) if spelt else np.zeros(len(names) - i - 1, np.int64)
        out += [(lang, names[i], "pair", b, v) for b, v in zip(names[i + 1 :], apart.tolist())]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, source) -> lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, most different first. Part ``term``: the ``BEST`` terms by how much their share in the
    source is above that in the language. Null texts, languages and sources count as ''; rows count as often as they are there; ties go by
    the bytes of the item; texts may be of any length, a text's terms being held by one task. A language with fewer than ``LEAST_DOCS``
    documents for any term has pairs of value 0. An empty table gives an empty result. Sources of a language are a matrix's rows, and their
    pairs are the result: its size is the number of sources squared."""
    counts = written(term_counts(docs), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("of")).where(F.col("of") >= LEAST_DOCS).select("lang", "term")
    kept = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept")
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0)
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kept").alias("kept"))
    cells = F.lit(float(TILE_CELLS))
    terms_of_tile = F.greatest(F.lit(1), F.least(F.greatest(cells / F.col("sources"), F.col("sources")), 8 * cells / F.col("sources")))
    sizes = sizes.select("lang", F.greatest(F.lit(1), F.ceil(F.col("kept") / terms_of_tile)).cast("long").alias("blocks"))
    # a row a language: sent along where they are few, so that no join deals the terms by language alone
    sizes = written(sizes, "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_LANGUAGES else sizes
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    terms = kept.join(sizes, "lang").select("lang", block, "source", "term", "n")
    groups = groups.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    tiles = terms.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInPandas(_tile, "lang string, source string, part string, item string, value long")
    tiles = written(tiles, "tiles")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("w")
    pairs = pairs.select("lang", ways, "part", "value").select("lang", "w.source", "part", "w.item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return pairs.withColumn("rank", F.row_number().over(order)).union(best.select("lang", "source", "part", "item", "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and the like: see ``divergence``."""
    return divergence(documents(spark, sf_dir))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
langs AS (SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept ON l.lang = kept.lang GROUP BY l.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS t, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lt FROM grid),
p AS (SELECT lang, source, term, n, 1 + CAST(n + {SMOOTH} AS HUGEINT) * {SCALE} // (t + {SMOOTH} * v) AS p, 1 + CAST(ln + {SMOOTH} AS HUGEINT) * {SCALE} // (lt + {SMOOTH} * v) AS q FROM sums JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
own AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
      UNION ALL
      SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM own)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {BEST}
"""
