"""Event log: cleaning, id encoding, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SESSION_GAP_MINUTES
from ..functions.scoring import MICROS_PER_DAY, micros
from ..sources.files import materialized

REQUIRED = ["datetime", "visitorid", "event", "itemid"]


def clean_events(raw: DataFrame) -> DataFrame:
    """Exact duplicates once (nulls are equal), rows without a key gone."""
    return raw.dropDuplicates().dropna(subset=REQUIRED)


def transaction_invariant(events: DataFrame) -> DataFrame:
    """One row: rows, and those that break "a transaction id if and only if a transaction". Only reported, never dropped."""
    broken = F.col("transactionid").isNull() != (F.col("event") != "transaction")
    return events.agg(F.count("*").alias("n_events"), F.count_if(broken).alias("n_broken"), F.coalesce(F.bool_and(~broken), F.lit(True)).alias("holds"))


def encode(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct sorted keys with a dense index from 0.

    Sorted by range over tasks and written, so that ranges are the same for both uses; keys are numbered within a range, and the
    ranges' sizes, a number each, are summed to offsets. No task ranks the whole table.
    """
    keys = df.select(key).dropna().distinct()
    ordered = materialized(keys.orderBy(key).withColumn("_part", F.spark_partition_id()), "keys")
    # row_number within a sorted partition, and the sum of the sizes of those before it
    within = ordered.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    before = ordered.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    return within.join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_in") - 1).cast("long").alias(name))


def session_name() -> Column:
    return F.concat_ws("_", "visitorid", "session_seq").alias("session_id")


#: A visitor's events are numbered by slices of so many days.
SLICE_DAYS = 1


def sessions(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, slice_days: float = SLICE_DAYS) -> DataFrame:
    """Events with session_seq (from 1 for each visitor) and session_id; a gap of more than the limit starts a session. Events have a visitor and a
    time, as ``clean_events`` leaves them.

    Events are ordered within slices of a visitor's time only, so a visitor with very many is in many tasks. A row a slice (first and last event, sessions
    that start inside) then tells over the slices of a visitor whether a slice's first event starts a session, and how many came before."""
    limit = gap_minutes * 60_000_000
    at = micros(F.col("datetime"))
    # events without a time are in a slice before all others, so that no join key is null and both sides of the join below read one shuffle
    sliced = events.withColumn("_slice", F.coalesce(F.floor(at / (slice_days * MICROS_PER_DAY)), F.lit(-1 << 62)))
    # events of one time are in one session, in whatever order: neither sort nor shuffle holds more than the time for it
    order = W.partitionBy("visitorid", "_slice").orderBy("datetime")
    inside = sliced.withColumn("_new", (F.coalesce(at - micros(F.lag("datetime").over(order)), F.lit(0)) > limit).cast("int"))
    spans = inside.groupBy("visitorid", "_slice").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_new").alias("_inside"))
    slices = W.partitionBy("visitorid").orderBy("_slice")
    starts = spans.withColumn("_start", F.when(F.col("_first") - F.lag("_last").over(slices) <= limit, 0).otherwise(1))
    before = F.sum(F.col("_start") + F.col("_inside")).over(slices) - F.col("_inside")
    starts = starts.select("visitorid", "_slice", before.alias("_before"))
    numbered = inside.withColumn("_within", F.sum("_new").over(order.rangeBetween(W.unboundedPreceding, W.currentRow)))
    joined = numbered.join(starts, ["visitorid", "_slice"]).withColumn("session_seq", F.col("_before") + F.col("_within"))
    return joined.where("datetime IS NOT NULL").select(*events.columns, "session_seq", session_name())


def session_summary(sessioned: DataFrame) -> DataFrame:
    """A row for each session: bounds, counts by event, duration in seconds. One aggregate over the sessioned events, by numbers: names are made of its rows."""
    found = sessioned.groupBy("visitorid", "session_seq").agg(
        F.min("datetime").alias("session_start"), F.max("datetime").alias("session_end"), F.count("*").alias("n_events"),
        F.count_if(F.col("event") == "view").alias("n_views"), F.count_if(F.col("event") == "addtocart").alias("n_addtocart"),
        F.count_if(F.col("event") == "transaction").alias("n_transactions"),
        ((micros(F.max("datetime")) - micros(F.min("datetime"))) / 1e6).alias("duration_sec"),
    )
    return found.select("visitorid", session_name(), *found.columns[2:])
