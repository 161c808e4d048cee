"""Scores: event weights, half-life decay, safe ratios, winsorized min-max scaling, parsing of coded numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EVENT_WEIGHTS, HALF_LIFE_DAYS, OUTLIER_PERCENTILE
from ..sources.files import materialized

MICROS_PER_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / float(MICROS_PER_DAY)


def event_weight(event: Column) -> Column:
    """Weight of an event type; types without one weigh 0."""
    out = F.lit(0.0)
    for name, weight in EVENT_WEIGHTS.items():
        out = F.when(event == name, weight).otherwise(out)
    return out


def half_life(age_days: Column, days: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), age_days / days)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def coded_number(value: Column) -> Column:
    """The number in a value like n123.000; null without the letter or without a number."""
    return F.when(value.rlike(r"^n[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.substring(value, 2, 1 << 20).try_cast("double"))


#: Of the sketch that tells where exact quantiles are to be looked for: its rank error is 1 / ACCURACY of the rows.
ACCURACY = 100_000


def exact_quantiles(df: DataFrame, column: str, at: list[float], out: list[str], extremes: bool = False) -> DataFrame:
    """One row with the exact interpolated quantiles of the known values; nulls without any. ``extremes`` adds _least and _most.

    Two scans, whatever the number of quantiles. A mergeable sketch gives for each two values between which it must lie. The second scan
    counts values: those within an interval each, and those outside by the interval that they follow. Only the distinct values within, some
    hundred-thousandths of the rows or ``ACCURACY`` values, are put in order, so no task holds all values.
    """
    x = df.select(F.col(column).alias("x")).where("x IS NOT NULL")
    slack = 3 / ACCURACY
    around = [max(0.0, min(1.0, a + d)) for a in at for d in (-slack, slack)]
    ends = x.agg(F.count("*").alias("rows"), F.percentile_approx("x", F.array(*map(F.lit, around)), ACCURACY).alias("e"), F.min("x").alias("_least"), F.max("x").alias("_most"))
    few = F.col("rows") <= ACCURACY  # then all are put in order: the sketch's error would be less than a row
    spans = [F.struct(F.when(few, F.col("_least")).otherwise(F.get("e", F.lit(2 * i))).alias("low"), F.when(few, F.col("_most")).otherwise(F.get("e", F.lit(2 * i + 1))).alias("high")) for i in range(len(at))]
    ends = ends.select("rows", "_least", "_most", F.array(*spans).alias("spans"))
    marked = x.crossJoin(F.broadcast(ends.select("spans")))  # one row
    within = F.exists("spans", lambda s: F.col("x").between(s["low"], s["high"]))
    # what lies outside comes right after the end of an interval, or before all
    after = F.array_max(F.transform(F.filter("spans", lambda s: s["high"] < F.col("x")), lambda s: s["high"]))
    counts = marked.select(F.when(within, F.col("x")).otherwise(after).alias("v"), (~within).alias("outside")).groupBy("v", "outside").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy(F.col("v").asc_nulls_first(), "outside"))).where("NOT outside").crossJoin(F.broadcast(ends.drop("spans")))
    found = []
    for i, a in enumerate(at):
        place = (F.col("rows") - 1) * F.lit(float(a))
        found += [F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))).alias(f"low{i}"), F.min(F.when(F.col("upto") > F.ceil(place), F.col("v"))).alias(f"high{i}"), F.any_value(place - F.floor(place)).alias(f"part{i}")]
    more = [F.any_value(c).alias(c) for c in ("_least", "_most")] if extremes else []
    values = [(F.col(f"low{i}") * (1 - F.col(f"part{i}")) + F.col(f"high{i}") * F.col(f"part{i}")).alias(name) for i, name in enumerate(out)]
    return upto.agg(*found, *more).select(*values, *(["_least", "_most"] if extremes else []))


def exact_quantile(df: DataFrame, column: str, at: float, out: str) -> DataFrame:
    """One row with the exact interpolated quantile of the known values; null without any."""
    return exact_quantiles(df, column, [at], [out])


def winsorized(df: DataFrame, raw: str, out: str, percentile: float = OUTLIER_PERCENTILE) -> DataFrame:
    """Adds ``out``: ``raw`` cut at its exact percentile and scaled to [0, 1]; 0 where all values are equal.

    ``df`` is written first, since its values are read three times. The statistics are one row, attached by a cross join with that row, not by a
    window over the table.
    """
    df = materialized(df, "scaled")
    bounds = F.broadcast(exact_quantiles(df, raw, [percentile], ["_cap"], extremes=True))
    low, high = F.least("_least", "_cap"), F.least("_most", "_cap")
    x = F.least(F.col(raw), F.col("_cap"))
    return df.crossJoin(bounds).withColumn(out, F.when(high == low, 0.0).otherwise((x - low) / (high - low))).drop("_cap", "_least", "_most")


def running_totals(counts: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``n`` over rows of a greater ``value`` (distinct; nulls come last). Rows are sorted by range over tasks and written, so that
    ranges are the same for both uses; sums run within a range, and the ranges' own sums, a number each, become offsets."""
    ordered = materialized(counts.orderBy(F.col(value).desc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranges")
    within = F.sum(n).over(W.partitionBy("_part").orderBy(F.col(value).desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1))
    offsets = ordered.groupBy("_part").agg(F.sum(n).alias("_sum")).withColumn("_offset", F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).drop("_sum")
    joined = ordered.withColumn("_within", within).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.coalesce("_within", F.lit(0)) + F.coalesce("_offset", F.lit(0))).drop("_part", "_within", "_offset")


def top_per(df: DataFrame, by: list[str], order: list[Column], n, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows (a number, or a column) of each group, with their rank from 1."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def by_score(score: str, key: str) -> list[Column]:
    """Order of ranked lists: highest score first, equal scores (to nine digits) by key."""
    return [F.round(score, 9).desc(), F.col(key).asc()]
