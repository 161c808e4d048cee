"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Level: a source's target is ``min(cap * size, level * weight)`` with the one level at which the targets add up to the
whole. Sorting sources by ``cap * size / weight`` gives that level in closed form: with the first j sources at their
cap, the rest share what is left by weight, and the first j for which nobody else is above its cap is the fixed point
of handing excess on again and again.

Sampling: a source's target over its size is a number of whole repetitions, which every document gets, and a fraction.
For the fraction documents are ordered by a seeded hash of their id and taken until the fraction of the source's words
is reached. That needs no sort of a source: words are summed by 256 ranges of the hash, then by 256 ranges of the one in which the
fraction ends, and so on; only the last such range is looked at document by document. No task gets more than 256 rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, whole, written

SEED, CAP = 42, 3
#: Bits of the hash that each of the levels of ranges tells apart.
LEVELS, LEVEL_BITS = 3, 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to one row per source with ``source_size`` and ``weight``. One row per source is little; the
    window over all of them is that of the named method. Sources without words get 0."""
    sized = sources.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), "rank")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(1))
    step = (
        sized.withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_caps_before", F.sum("_cap").over(upto) - F.col("_cap"))
        .withColumn("_weights_before", F.sum("weight").over(upto) - F.col("weight"))
        .withColumn("_level", (F.col("_total") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before")))
        .withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
        .withColumn("_at", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("rank"), F.col("_level").alias("level")))).over(every))
    )
    return step.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_at.level") * F.col("weight"), F.col("_cap")))).drop("_cap", "_total", "_weights", "_caps_before", "_weights_before", "_level", "_free", "_at")


def hashed(doc_id: Column, seed: int = SEED) -> Column:
    """48 bits of the MD5 of seed and id: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def mix(docs: DataFrame, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source; other columns are ignored) -> doc_id, source, size, source_size, target, repeats, taken.

    Null text has size 0; a null source is a source of its own, ordered last. Rows that repeat a doc_id are taken or left
    together. No document is taken more than ``cap`` times: the fraction is only dealt where the target is below the cap.
    Equal hashes are ordered by doc_id. A text of any length counts whole. An empty table gives an empty result.
    """
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hashed(F.col("doc_id"), seed).alias("h")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    plan = (
        water_fill(sources.withColumn("weight", (F.col("rank") - 1) % 3 + 1), cap)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "goal")
    )
    plan = written(plan, "plan")
    state = plan.withColumns({"end_slot": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        bits = 48 - LEVEL_BITS * level
        upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow))
        inside = sizes.alias("s").join(state.alias("p"), F.expr("s.source <=> p.source") & (F.shiftright("h", bits + LEVEL_BITS) == F.col("end_slot")))
        cells = inside.groupBy("p.source", "goal", "before", F.shiftright("h", bits).alias("slot")).agg(F.sum("size").alias("words"))
        ends = cells.withColumn("upto", upto).where(F.col("upto") > F.col("goal")).groupBy(F.col("source").alias("of")).agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
        # without an end the goal is the whole source
        state = written(plan.join(ends, F.expr("source <=> of"), "left").select("source", "source_size", "target", "whole", "goal", F.col("end.slot").alias("end_slot"), F.col("end.before").alias("before")), "cut")
    plan, slot = state, F.shiftright("h", 48 - LEVEL_BITS * LEVELS)
    near = sizes.alias("s").join(plan.alias("p"), (F.expr("s.source <=> p.source")) & (slot == F.col("end_slot")))
    last = (
        near.groupBy("s.source", "h", "doc_id", "goal", "before").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("h", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)))
        # the document at the end is taken if that brings the sum nearer to the goal
        .where(F.col("upto") - F.col("words") / 2.0 <= F.col("goal"))
        .select("source", F.col("h").alias("at"), F.col("doc_id").alias("id"), F.lit(1).alias("more"))
    )
    last = written(last, "last")
    return (
        sizes.alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source"), "left")
        .join(last.alias("l"), F.expr("s.source <=> l.source AND s.h = l.at AND s.doc_id <=> l.id"), "left")
        .select("s.doc_id", "s.source", "size", "source_size", "target", (F.col("whole") + F.when(F.col("goal") <= 0, 0).when(F.coalesce(slot < F.col("end_slot"), F.lit(True)), 1).otherwise(F.coalesce("more", F.lit(0)))).cast("long").alias("repeats"))
        .withColumn("taken", F.col("size") * F.col("repeats"))
    )


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document as many times as ``mixed`` says, with the columns of ``docs``."""
    # a row of ``mixed`` per doc_id decides; rows of docs that share a doc_id share its hash, and so the decision
    counts = mixed.groupBy("doc_id", "source").agg(F.max("repeats").alias("n")).where("n > 0")
    taken = docs.select(whole(docs)).join(counts.alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.source <=> c.source"))
    return taken.select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("d.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and the like: see ``mix``."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
       FROM s2 WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lv AS (SELECT arg_min(level, ROW(cap / weight, rank)) AS level FROM s3 WHERE level * weight <= cap),
s4 AS (SELECT source, source_size, least(cap, (SELECT level FROM lv) * weight) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s4),
s6 AS (SELECT *, target - whole * source_size AS goal FROM s5),
k AS (SELECT doc_id, source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) AS words
      FROM d GROUP BY doc_id, source, h)
SELECT d.doc_id, d.size, s6.source_size, s6.target,
       CAST(d.size * (s6.whole + CASE WHEN s6.goal > 0 AND k.upto - k.words / 2.0 <= s6.goal THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.h = k.h
"""
