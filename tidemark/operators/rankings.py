"""Popularity rankings and catalog search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOP_K
from ..functions.scoring import by_score


def trending(items: DataFrame, n: int = TOP_K, category: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Items by decayed interaction score; a null category never matches. ``exclude``: itemid."""
    if category is not None:
        items = items.where(F.col("categoryid") == category)
    if exclude is not None:
        items = items.join(exclude.select("itemid").distinct(), "itemid", "left_anti")
    return items.orderBy(*by_score("product_interaction_score", "itemid")).limit(n).select("itemid", "categoryid", "product_interaction_score")


def best_sellers(items: DataFrame, n: int = TOP_K, category: int | None = None) -> DataFrame:
    if category is not None:
        items = items.where(F.col("categoryid") == category)
    return items.orderBy(F.desc("item_transaction_count"), "itemid").limit(n).select("itemid", "categoryid", "item_transaction_count")


def recently_popular(events: DataFrame, attributes: DataFrame, n: int = TOP_K, days: int = 7, category: int | None = None) -> DataFrame:
    """Items by events of any type in the last days before the last event; items outside the catalog have a null category."""
    # a scalar subquery is a value when the events are read, so that the cutoff reaches the scan
    cutoff = events.agg(F.max("datetime") - F.expr(f"INTERVAL {int(days)} DAYS")).scalar()
    recent = events.where(F.col("datetime") >= cutoff).groupBy("itemid").agg(F.count("*").alias("recent_interactions"))
    recent = recent.join(attributes.select("itemid", "categoryid"), "itemid", "left")
    if category is not None:
        recent = recent.where(F.col("categoryid") == category)
    return recent.orderBy(F.desc("recent_interactions"), "itemid").limit(n)


def search(items: DataFrame, item_id: int | None = None, category: int | None = None, in_stock: bool = False, price: tuple[float, float] | None = None, n: int = 100) -> DataFrame:
    """Catalog rows that meet all given conditions, most viewed first. Rows without a price meet any price range."""
    if item_id is not None:
        items = items.where(F.col("itemid") == item_id)
    if category is not None:
        items = items.where(F.col("categoryid") == category)
    if in_stock:
        items = items.where("available = 1")
    if price is not None:
        items = items.where(F.col("price").isNull() | F.col("price").between(*price))
    return items.orderBy(F.desc("item_view_count"), "itemid").limit(n)
