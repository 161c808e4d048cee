"""Feature tables of users, categories and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import days_between, event_weight, half_life, ratio, running_totals, winsorized


def with_decayed_weight(events: DataFrame) -> DataFrame:
    """Adds weight: the event's weight, halved every half-life before the last event of the table."""
    last = events.agg(F.max("datetime").alias("_last"))
    return events.crossJoin(F.broadcast(last)).withColumn("weight", event_weight(F.col("event")) * half_life(days_between(F.col("_last"), F.col("datetime"))))


#: Counts of a visitor's events.
EVENT_COUNTS = {"view": "user_view_count", "addtocart": "user_addtocart_count", "transaction": "user_purchase_count"}


def event_counts(prefix: str) -> list:
    names = {"view": f"{prefix}_view_count", "addtocart": f"{prefix}_addtocart_count", "transaction": f"{prefix}_transaction_count"}
    return [F.count_if(F.col("event") == e).alias(n) for e, n in names.items()]


def visits(events: DataFrame, attributes: DataFrame, *more) -> DataFrame:
    """A row for each visitor, of exact distinct counts and sums. Distinct counts are aggregates of aggregates: of the distinct pairs (visitor, item), then of (visitor,
    category), rows that hold nothing else; those and the events are then added up by visitor at once.
    No row is expanded for each count, a visitor's many events are added up in many tasks, and categories are joined to pairs, not to events.
    ``more``: further (name, aggregate of events that passes over nulls)."""
    counts = [(c, F.count_if(F.col("event") == e)) for e, c in EVENT_COUNTS.items()]
    pairs = events.select("visitorid", "itemid").distinct().join(attributes.select("itemid", "categoryid"), "itemid", "left")
    by_category = pairs.groupBy("visitorid", "categoryid").agg(F.count("itemid").alias("unique_items_viewed"))
    distinct = [("unique_items_viewed", F.sum("unique_items_viewed")), ("unique_categories_viewed", F.count("categoryid"))]
    both = events.unionByName(by_category, allowMissingColumns=True)
    return both.groupBy("visitorid").agg(*[kept.alias(name) for name, kept in [*distinct, *counts, *more]])


def user_features(events: DataFrame, sessions: DataFrame, attributes: DataFrame) -> DataFrame:
    weighted = with_decayed_weight(events)
    seen = [("first_seen", F.min("datetime")), ("last_seen", F.max("datetime")), ("activity_score_raw", F.sum("weight")), ("_last", F.max("_last"))]
    own = visits(weighted, attributes, *seen)
    # a session is a row, so there is nothing to tell apart
    stays = sessions.groupBy("visitorid").agg(F.count("session_id").alias("n_sessions"), F.avg("duration_sec").alias("avg_session_duration_sec"), F.percentile("duration_sec", F.lit(0.5)).alias("median_session_duration_sec"))
    joined = own.join(stays, "visitorid", "full").fillna(0, ["user_view_count", "user_addtocart_count", "user_purchase_count"]).fillna(0.0, ["activity_score_raw"])
    rated = (
        joined.withColumn("recency_days", days_between(F.col("_last"), F.col("last_seen")))
        .withColumn("conversion_rate_user", ratio(F.col("user_purchase_count"), F.col("user_view_count")))
        .withColumn("click_to_purchase_ratio_user", ratio(F.col("user_purchase_count"), F.col("user_addtocart_count"))).drop("_last")
    )
    return winsorized(rated, "activity_score_raw", "user_activity_score")


def category_features(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """Categories with an event only."""
    by_item = events.groupBy("itemid").agg(*event_counts("category"))
    counts = [c for c in by_item.columns if c != "itemid"]
    counted = by_item.join(attributes.select("itemid", "categoryid"), "itemid").where("categoryid IS NOT NULL").groupBy("categoryid").agg(*[F.sum(c).alias(c) for c in counts])
    counted = counted.withColumn("total_interactions", F.expr("category_view_count + category_addtocart_count + category_transaction_count"))
    items = attributes.where("categoryid IS NOT NULL").groupBy("categoryid").agg(F.count_distinct("itemid").alias("num_items_in_category"))
    return winsorized(counted.join(items, "categoryid", "left").fillna(0, ["num_items_in_category"]), "total_interactions", "category_popularity_score")


def competition_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank by ``value`` from the highest; equal values share the first rank. Distinct values are ranked, not rows."""
    counts = running_totals(df.groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_before")
    return df.join(counts.select(value, (F.col("_before") + 1).cast("int").alias(out)), value, "left")


def item_features(events: DataFrame, attributes: DataFrame, categories: DataFrame) -> DataFrame:
    """All items of the catalog, those without events as well; items that only have events are not there."""
    weighted = with_decayed_weight(events)
    own = weighted.groupBy("itemid").agg(*event_counts("item"), F.max("datetime").alias("last_seen"), F.sum("weight").alias("interaction_score_raw"))
    # only distinct pairs go through the larger shuffle
    met = events.select("itemid", "visitorid").distinct().groupBy("itemid").agg(F.count("visitorid").alias("unique_visitors"))
    counts = ["item_view_count", "item_addtocart_count", "item_transaction_count", "unique_visitors"]
    joined = attributes.join(own.join(met, "itemid"), "itemid", "left").fillna(0, counts).fillna(0.0, ["interaction_score_raw"])
    last = events.agg(F.max("datetime").alias("_last"))
    rated = (
        joined.crossJoin(F.broadcast(last))
        .withColumn("is_cold_start", F.expr("item_view_count + item_addtocart_count + item_transaction_count = 0"))
        .withColumn("recency_days", F.coalesce(days_between(F.col("_last"), F.col("last_seen")), F.lit(float("inf"))))
        .withColumn("product_conversion_rate", ratio(F.col("item_transaction_count"), F.col("item_view_count")))
        .withColumn("click_to_purchase_ratio_item", ratio(F.col("item_transaction_count"), F.col("item_addtocart_count"))).drop("_last")
    )
    scaled = competition_rank(winsorized(rated, "interaction_score_raw", "product_interaction_score"), "item_view_count", "popularity_rank")
    return scaled.join(categories.select("categoryid", "category_popularity_score"), "categoryid", "left").fillna(0.0, ["category_popularity_score"])
