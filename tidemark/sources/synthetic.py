"""A synthetic clickstream in Spark: Zipf-like items, Pareto-like visitors, a view-cart-purchase funnel, duplicates, a property log
and multi-item baskets. Seeded by hashes of row numbers, so any number of partitions gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

FUNNEL = {"view": 0.86, "addtocart": 0.105, "transaction": 0.035}
DUPLICATES, PROPERTY_DUPLICATES, NULL_VALUES = 0.003, 0.01, 0.005


def uniform(seed: int, *cols) -> F.Column:
    """A number in (0, 1) from a seed and columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def category_tree(spark: SparkSession, n: int = 120, roots: int = 10, seed: int = 42) -> DataFrame:
    """categoryid 1..n; the first ``roots`` have no parent, others a smaller id."""
    c = F.col("categoryid")
    return spark.range(1, n + 1).withColumnRenamed("id", "categoryid").select("categoryid", F.when(c > roots, 1 + F.floor(uniform(seed, c) * (c - 1))).cast("long").alias("parentid"))


def item_properties(spark: SparkSession, items: int = 3000, categories: int = 120, days: int = 120, seed: int = 42) -> DataFrame:
    """timestamp, itemid, property, value: category, availability and coded price, some rows twice, some values null."""
    base = spark.range(1, items + 1).withColumnRenamed("id", "itemid")
    value = {
        "categoryid": (1 + F.floor(uniform(seed, "itemid", F.lit("c")) * categories)).cast("string"),
        "available": (uniform(seed, "itemid", F.lit("a")) < 0.8).cast("int").cast("string"),
        "790": F.concat(F.lit("n"), F.round(F.exp(uniform(seed, "itemid", F.lit("p")) * 5 + 2), 3).cast("decimal(12,3)").cast("string")),
    }
    rows = base.select("itemid", F.explode(F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in value.items()])).alias("p")).select("itemid", "p.*")
    rows = rows.select((F.floor(uniform(seed, "itemid", "property") * days) * 86_400_000).cast("long").alias("timestamp"), "itemid", "property", F.when(uniform(seed + 1, "itemid", "property") >= NULL_VALUES, F.col("value")).alias("value"))
    return rows.unionByName(rows.where(uniform(seed + 2, "itemid", "property") < PROPERTY_DUPLICATES))


def events(spark: SparkSession, n: int = 120_000, users: int = 4000, items: int = 3000, days: int = 120, seed: int = 42) -> DataFrame:
    """timestamp, visitorid, event, itemid, transactionid; popularity of items falls as 1 / rank, activity of visitors as a Pareto law."""
    i = F.col("id")
    kind = uniform(seed, i, F.lit("k"))
    event = F.when(kind < FUNNEL["view"], "view").when(kind < FUNNEL["view"] + FUNNEL["addtocart"], "addtocart").otherwise("transaction")
    rows = spark.range(n).select(
        F.floor(uniform(seed, i, F.lit("t")) * days * 86_400_000).cast("long").alias("timestamp"),
        F.least(F.floor(F.pow(uniform(seed, i, F.lit("v")), 3) * users) + 1, F.lit(users)).cast("long").alias("visitorid"),
        event.alias("event"),
        F.least(F.floor(F.exp(uniform(seed, i, F.lit("i")) * F.log(F.lit(float(items))))), F.lit(items)).cast("long").alias("itemid"),
        F.when(event == "transaction", i).alias("transactionid"),
    )
    return rows.unionByName(rows.where(uniform(seed + 3, "timestamp", "visitorid", "itemid") < DUPLICATES))


def with_baskets(log: DataFrame, properties: DataFrame, probability: float = 0.35, most: int = 2, seed: int = 42) -> DataFrame:
    """Adds up to ``most`` items of the same category to a share of transactions, as further rows of the same transaction."""
    category = properties.where("property = 'categoryid' AND value IS NOT NULL").groupBy("itemid").agg(F.max("value").alias("category"))
    # companions are found by position in their category, so no category is joined with itself
    numbered = category.select("category", "itemid", (F.row_number().over(Window.partitionBy("category").orderBy("itemid")) - 1).alias("at"))
    sizes = numbered.groupBy("category").agg(F.count("*").alias("size"))
    sold = log.where("event = 'transaction'").dropDuplicates(["transactionid"]).where(uniform(seed + 4, "transactionid") < probability)
    wanted = sold.join(category, "itemid").join(sizes, "category").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("at", F.floor(uniform(seed + 5, "transactionid", "k") * F.col("size")).cast("int"))
    more = wanted.select("timestamp", "visitorid", "event", "transactionid", "category", "at", F.col("itemid").alias("bought")).join(numbered, ["category", "at"]).where("itemid <> bought")
    return log.unionByName(more.select(log.columns).dropDuplicates(["transactionid", "itemid"]))


def write_raw(spark: SparkSession, folder: str, n: int = 120_000, users: int = 4000, items: int = 3000, categories: int = 120, days: int = 120, seed: int = 42) -> None:
    """The four raw files (events, two parts of the property log, the category tree) as CSV with headers, as ``load_all`` reads them."""
    log = item_properties(spark, items, categories, days, seed)
    first = F.pmod(F.xxhash64("itemid", "property"), F.lit(2)) == 0
    tables = {
        "events": with_baskets(events(spark, n, users, items, days, seed), log, seed=seed), "item_properties_part1": log.where(first), "item_properties_part2": log.where(~first),
        "category_tree": category_tree(spark, categories, seed=seed),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
