"""Catalog: latest values of the property log, the category tree and its ancestors, price buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PRICE_BUCKETS
from ..functions.scoring import coded_number, exact_quantiles
from ..sources.files import materialized

PROPERTIES = {"categoryid": "categoryid", "available": "available", "790": "price"}


def item_attributes(log: DataFrame) -> DataFrame:
    """timestamp, itemid, property, value -> a row for each item with one of the three properties: their latest values, one
    aggregate. The latest value may be null, and then is the value. Of equal times the largest value counts."""
    known = log.where(F.col("property").isin(*PROPERTIES))
    wide = known.groupBy("itemid").agg(*[F.max(F.when(F.col("property") == p, F.struct("timestamp", "value"))).getField("value").alias(n) for p, n in PROPERTIES.items()])
    return (
        wide.withColumn("categoryid", F.col("categoryid").try_cast("double").cast("long"))
        .withColumn("available", F.coalesce(F.col("available").try_cast("double").cast("int"), F.lit(1)))
        .withColumn("price", coded_number(F.col("price")))
        .select("itemid", "categoryid", "available", F.col("categoryid").isNotNull().alias("has_category"), "price", F.col("price").isNotNull().alias("has_price"))
    )


def category_tree(raw: DataFrame) -> DataFrame:
    """One row for each category (of several, the one with the smallest parent; no parent comes first), with is_root."""
    first = raw.dropna(subset=["categoryid"]).groupBy("categoryid").agg(F.min(F.struct(F.col("parentid").isNotNull(), F.col("parentid").alias("parentid"))).getField("parentid").alias("parentid"))
    return first.withColumn("is_root", F.col("parentid").isNull())


def ancestors(categories: DataFrame, tree: DataFrame) -> DataFrame:
    """categoryid -> categoryid, ancestor, for itself and all above, in a tree of any depth; ends at cycles.

    Pointer doubling: after k rounds a category knows what lies less than 2**k levels above it, and the one 2**k above. What that one
    knows doubles it. So a path of 5,000 levels takes 13 rounds; where no jump is left, or cycles bring nothing new, all is known."""
    known = materialized(tree.select("categoryid", F.col("categoryid").alias("ancestor")), "ancestors")
    jumps = materialized(tree.where("parentid IS NOT NULL").select("categoryid", F.col("parentid").alias("to")), "jumps")
    size = known.count()
    while not jumps.isEmpty():
        # an ancestor that is no category of its own has nothing above it
        further = jumps.join(known.withColumnsRenamed({"categoryid": "to"}), "to", "left").select("categoryid", F.coalesce("ancestor", "to").alias("ancestor"))
        known = materialized(known.union(further).distinct(), "ancestors")
        before, size = size, known.count()
        if size == before:
            break
        jumps = materialized(jumps.join(jumps.select(F.col("categoryid").alias("to"), F.col("to").alias("next")), "to").select("categoryid", F.col("next").alias("to")), "jumps")
    asked = categories.select("categoryid").dropna().distinct()
    return asked.join(known, "categoryid", "left").select("categoryid", F.coalesce("ancestor", "categoryid").alias("ancestor"))


def price_cuts(items: DataFrame, q: int = PRICE_BUCKETS) -> DataFrame:
    """One row: the inner quantiles of known prices; equal cuts count once."""
    at = [i / q for i in range(1, q)]
    found = exact_quantiles(items, "price", at, [f"c{i}" for i in range(len(at))])
    return found.select(F.array_distinct(F.filter(F.array(*found.columns), lambda c: c.isNotNull())).alias("cuts"))


def price_bucket(price: Column, cuts: Column) -> Column:
    """Buckets from 0, closed on the right; null without a price."""
    return F.when(price.isNotNull(), F.size(F.filter(cuts, lambda c: price > c)))


def with_price_bucket(items: DataFrame, q: int = PRICE_BUCKETS) -> DataFrame:
    return items.crossJoin(F.broadcast(price_cuts(items, q))).withColumn("price_bucket", price_bucket(F.col("price"), F.col("cuts"))).drop("cuts")
