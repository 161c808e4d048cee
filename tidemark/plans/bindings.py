"""The given tables as a clickstream, a catalog and baskets.

Clickstream: events; a click is an addtocart, a purchase a transaction, other types stay as they are and weigh nothing.
Catalog: part, with a category for each type and brand under one for each type, as a property log of two versions.
Baskets: lineitem and orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of numbers are packed into a few bytes in a shuffle, and take a hundred times that in a task's joins and groups. So adaptive execution is to make small
#: parts, of which it has enough to put together; by default a task's memory would grow with the tables.
SHUFFLE_PARTS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600", "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(4 << 20)}
#: A union of tables in equal parts is not to count as parted so itself: where adaptive execution then changes one of them, a run of hybrid_explain_seeded failed
#: (1,800 parts of three tables were to meet 600), and what follows such a union is not put together to fewer parts.
SHUFFLE_PARTS["spark.sql.unionOutputPartitioning"] = "false"
#: A table is broadcast by the size of its files, which for rows of ids and small weights is a hundredth of what the driver has to hold: 10 MB of files were 4 million rows.
#: So only small files count (were all rows alike, even those could hold many), and adaptive execution broadcasts what has proved small once it was read.
BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": str(256 << 10), "spark.sql.adaptive.autoBroadcastJoinThreshold": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    started = spark.sparkContext.getConf()  # what a session was started with stays
    for key, value in SHUFFLE_PARTS.items():
        if not started.contains(key):
            spark.conf.set(key, value)
    if not any(started.contains(key) for key in BROADCASTS):
        for key, value in BROADCASTS.items():
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "addtocart").when(F.col("event_type") == "purchase", "transaction").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").where(only).select(
        F.col("user_id").cast("long").alias("visitorid"), kind.alias("event"), F.get_json_object("props", "$.k").try_cast("long").alias("itemid"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transactionid"), F.col("ts").cast("timestamp").alias("datetime"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clickstream with every hundredth row twice."""
    return events(spark, sf_dir).unionByName(events(spark, sf_dir, "event_id % 100 = 0"))


def _numbered(parts: DataFrame, column: str, out: str) -> DataFrame:
    """A small dimension's distinct values with their number from 1."""
    return parts.select(column).distinct().withColumn(out, F.row_number().over(W.orderBy(column)).cast("long"))


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    leaves = part.select("p_type", "p_brand").distinct().join(F.broadcast(_numbered(part, "p_type", "t")), "p_type").join(F.broadcast(_numbered(part, "p_brand", "b")), "p_brand")
    roots = _numbered(part, "p_type", "t").select(F.col("t").alias("categoryid"), F.lit(None).cast("long").alias("parentid"))
    return roots.unionByName(leaves.select((F.col("t") * 100 + F.col("b")).alias("categoryid"), F.col("t").alias("parentid")))


def property_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timestamp, itemid, property, value: an old and a new version of each property; every 50th new price is null."""
    part = table(spark, sf_dir, "part")
    p = part.join(F.broadcast(_numbered(part, "p_type", "t")), "p_type").join(F.broadcast(_numbered(part, "p_brand", "b")), "p_brand")
    price = F.concat(F.lit("n"), F.col("p_retailprice").cast("decimal(12,3)").cast("string"))
    rows = [
        (1, "categoryid", F.col("t").cast("string")), (2, "categoryid", (F.col("t") * 100 + F.col("b")).cast("string")),
        (1, "790", F.lit("n1.000")), (2, "790", F.when(F.col("p_partkey") % 50 != 0, price)),
        (1, "available", F.lit("0")), (2, "available", F.when(F.col("p_partkey") % 10 == 0, "0").otherwise("1")),
        (1, "888", F.lit("n7.000")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("timestamp"), F.lit(k).alias("property"), v.alias("value")) for t, k, v in rows]))
    return p.select(F.col("p_partkey").alias("itemid"), each.alias("r")).select("r.timestamp", "itemid", "r.property", "r.value")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visitorid, event, itemid, transactionid, datetime of order lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("visitorid"), F.lit("transaction").alias("event"), F.col("l_partkey").alias("itemid"), F.col("l_orderkey").alias("transactionid"), F.col("o_orderdate").cast("timestamp").alias("datetime"))
