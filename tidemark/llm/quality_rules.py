"""Quality rules whose cutoffs follow the data: for each language and source, quantiles of a few text measures come from
mergeable sketches, and documents beyond the fences go. DataFrame operations only.

The sketch of a measure is a table of counts by bucket. A bucket keeps the ``PRECISION`` leading bits of an integer, so its
width is at most 1/128 of its value. Sketches merge by adding counts: in partial aggregates of tasks, and from sources to their
language. A source's sketch is topped up by its language's with the weight of ``TOP_UP`` documents: the fewer documents a source
has, the more it goes by its language, at any size. A group costs some thousand rows, however many documents it has.

A fence stands off the outer quantile (``OUTER`` percent, or 100 - ``OUTER`` below) by ``SPREAD`` times that quantile's distance from
the median. Where the outer quantile of a count is 0, as of rare things, the sketch still bounds their rate: if ``OUTER`` percent of documents have
none in a typical length, the rate is at most -ln(OUTER / 100) to that length, and no fence is below this, so that every fence grows with a text's length. What is
counted by the document (symbols, repeats) may be above the fence by its own sampling error, ``ERRORS`` standard errors of the count that the fence lets
expect and one more: some symbols or one repeated line in a short text are no sign.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, GAP, whole, WORD, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
PRECISION = 8
#: Documents of its language that a source's sketch is topped up with.
TOP_UP = 400
OUTER, SPREAD, ERRORS = 90, 3, 6
#: Measure: what is counted, for how many of what. Counts have an upper fence; a mean (None: of characters to a word, in 1/100) has two.
MEASURES = {
    "symbols": ("n_symbols", "n_words"),
    "word_length": (None, "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("((n_repeat_words + 5) {div} 6)", "n_words"),  # a window that comes twice has six words
    "capitals": ("n_capitals", "word_chars"),
}
#: What counts are held against; sketched too, for typical lengths.
LENGTHS = ("n_words", "n_lines", "word_chars")
#: The rate for 1,000, times a typical length, that leaves ``OUTER`` percent of documents of that length without any.
RARE = 1000 * -math.log(OUTER / 100)


def value_of(measure: str, div: str = "div") -> str:
    if measure in LENGTHS:
        return measure
    count, of = MEASURES[measure]
    return f"{count.format(div=div)} * 1000 {div} {of}" if count else f"word_chars * 100 {div} {of}"


def inside(div: str = "div") -> str:
    """Whether a document is within all fences (SQL for either engine). A sketch knows a value by its bucket's lower end, which lies at
    most 1/128 below."""
    out = []
    for k, (count, of) in MEASURES.items():
        high = f"(high_{k} + high_{k} / 128)"
        if count:
            above = f"({count.format(div=div)} * CAST(1000 AS DOUBLE) - {high} * {of})"
            out.append(f"({above} <= 0 OR {above} * {above} <= {ERRORS * ERRORS * 1000} * ({high} * {of} + 1000))")
        else:
            out.append(f"{value_of(k, div)} BETWEEN low_{k} AND {high}")
    return " AND ".join(out)


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows' hashes sorted with their positions, equal neighbours
    kept, and the positions' union of three words each counted. Linear in the text but for the sort."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    return F.when(F.size(words) >= 4, F.sort_array(windows))


def covered(ordered: Column) -> Column:
    def again(x: Column, i: Column) -> Column:
        return F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False))

    at = F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(at, start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n")), lambda a: a["n"])
    return F.coalesce(total, F.lit(0)).cast("long")


def measured(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` -> d (struct of all its columns), lang, source and the base columns."""
    text = F.coalesce(F.col("d.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.select(whole(docs))
        .select("d", F.filter(F.split(text, GAP), lambda w: w != "").alias("words"), lines.alias("lines"))
        .select("d", "lines", F.size("words").cast("long").alias("n_words"), repeat_words(F.col("words")).alias("ordered"))
        .select(
            "d", F.col("d.lang").alias("lang"), F.col("d.source").alias("source"), "n_words",
            (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            covered(F.col("ordered")).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        )
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def sketches(base: DataFrame) -> DataFrame:
    """lang, source, measure, low, n: counts by bucket of the documents that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(value_of(k)).cast("long").alias("v")) for k in (*MEASURES, *LENGTHS)])).alias("m")
    v = F.col("m.v")
    # not shiftleft by a column's value of bin's length at once: both shifts take an int
    bits = F.greatest(F.length(F.bin(v)) - PRECISION, F.lit(0)).cast("int")
    return (
        base.where("NOT base_failed").select("lang", "source", values)
        .select("lang", "source", F.col("m.measure").alias("measure"), F.call_function("shiftleft", F.call_function("shiftright", v, bits), bits).alias("low"))
        .groupBy("lang", "source", "measure", "low").agg(F.count("*").alias("n"))
    )


def blended(counts: DataFrame) -> DataFrame:
    """Sketches of sources, topped up by those of their languages."""
    language = counts.groupBy("lang", "measure", "low").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy("lang", "measure"))
    share = language.withColumn("n", F.lit(float(TOP_UP)) * F.col("n") / total).withColumnsRenamed({"lang": "of"})
    own = counts.select("lang", "source").distinct()
    topped = own.join(share, F.expr("lang <=> of")).select("lang", "source", "measure", "low", "n")
    return counts.select("lang", "source", "measure", "low", F.col("n").cast("double")).union(topped).groupBy("lang", "source", "measure", "low").agg(F.sum("n").alias("n"))


def thresholds(base: DataFrame) -> DataFrame:
    """lang, source and for each measure the fence high_*, and low_* for the mean, as doubles."""
    whole = W.partitionBy("lang", "source", "measure")
    upto = whole.orderBy("low").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = blended(written(sketches(base), "sketches")).withColumn("upto", F.sum("n").over(upto) * 100 + 1e-6).withColumn("all", F.sum("n").over(whole))
    at = {q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("low"))).cast("double").alias(f"q{q}") for q in (100 - OUTER, 50, OUTER)}
    quantiles = ranked.groupBy("lang", "source", "measure").agg(*at.values())
    high = F.col(f"q{OUTER}") + SPREAD * (F.col(f"q{OUTER}") - F.col("q50"))
    low = F.col(f"q{100 - OUTER}") - SPREAD * (F.col("q50") - F.col(f"q{100 - OUTER}"))
    rare = {of: F.lit(RARE) / F.max(F.when(F.col("measure") == of, F.col("q50"))) for of in LENGTHS}
    fence = {k: F.max(F.when(F.col("measure") == k, high)) for k in MEASURES}
    found = [(F.greatest(fence[k], rare[of]) if count else fence[k]).alias(f"high_{k}") for k, (count, of) in MEASURES.items()]
    found += [F.max(F.when(F.col("measure") == k, low)).alias(f"low_{k}") for k, (count, _) in MEASURES.items() if not count]
    return quantiles.groupBy("lang", "source").agg(*found)


def judged(base: DataFrame) -> DataFrame:
    """``base`` with kept."""
    limits = written(thresholds(base), "thresholds")
    joined = base.alias("b").join(limits.alias("t"), F.expr("b.lang <=> t.lang AND b.source <=> t.source"), "left")
    return joined.select("b.*", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.expr(inside()), F.lit(False))).alias("kept"))


def quality(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, lang, source; others are carried in ``d``) -> a row per row: d, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    Null texts count as empty and fail; null languages and sources are groups of their own. Rows that repeat a doc_id or a text are judged,
    and counted in sketches, each. Equal values fall in one bucket, so ties are judged alike. A text may be of any length: its three-word
    windows are sorted within its row. An empty table gives an empty result."""
    return judged(written(measured(docs, min_words), "measures"))


def passing(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    return quality(docs, min_words).where("kept").select("d.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and the like: see ``quality``."""
    base = measured(documents(spark, sf_dir)).withColumn("d", F.struct(F.col("d.doc_id").alias("doc_id")))
    return judged(written(base, "measures")).select("d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    # DuckDB divides integers by //
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {value_of(k, '//')} AS v FROM base WHERE NOT base_failed" for k in (*MEASURES, *LENGTHS))
    quantiles = ", ".join(f"CAST(min(CASE WHEN upto >= {q} * a THEN low END) AS DOUBLE) AS q{q}" for q in (100 - OUTER, 50, OUTER))
    fences = {k: f"max(CASE WHEN measure = '{k}' THEN q{OUTER} + {SPREAD} * (q{OUTER} - q50) END)" for k in MEASURES}
    rare = {of: f"CAST({RARE!r} AS DOUBLE) / max(CASE WHEN measure = '{of}' THEN q50 END)" for of in LENGTHS}
    fence = ", ".join([f"greatest({fences[k]}, {rare[of]}) AS high_{k}" if count else f"{fences[k]} AS high_{k}" for k, (count, of) in MEASURES.items()] + [f"max(CASE WHEN measure = '{k}' THEN q{100 - OUTER} - {SPREAD} * (q50 - q{100 - OUTER}) END) AS low_{k}" for k, m in MEASURES.items() if not m[0]])
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 4),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p], words[p + 1], words[p + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p + o) AS n FROM h, (SELECT unnest([0, 1, 2]) AS o) WHERE n >= 2 GROUP BY rid),
b0 AS (SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
      FROM w LEFT JOIN r ON w.rid = r.rid),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b0),
v AS ({rows}),
c AS (SELECT lang, source, measure, (v >> greatest(len(bin(v)) - {PRECISION}, 0)) << greatest(len(bin(v)) - {PRECISION}, 0) AS low, count(*) AS n FROM v GROUP BY ALL),
cl AS (SELECT lang, measure, low, {TOP_UP} * CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY lang, measure) AS n FROM c GROUP BY lang, measure, low),
m AS (SELECT lang, source, measure, low, sum(n) AS n FROM (
        SELECT lang, source, measure, low, CAST(n AS DOUBLE) AS n FROM c UNION ALL
        SELECT o.lang, o.source, measure, low, n FROM (SELECT DISTINCT lang, source FROM c) o JOIN cl ON o.lang IS NOT DISTINCT FROM cl.lang) GROUP BY ALL),
q AS (SELECT lang, source, measure, {quantiles} FROM (
        SELECT *, 100 * sum(n) OVER (PARTITION BY lang, source, measure ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-6 AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS a FROM m)
      GROUP BY lang, source, measure),
th AS (SELECT lang, source, {fence} FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN FALSE ELSE coalesce({inside('//')}, FALSE) END AS kept
FROM base b LEFT JOIN th ON b.lang IS NOT DISTINCT FROM th.lang AND b.source IS NOT DISTINCT FROM th.source
"""


OP3_SQL = _sql()
