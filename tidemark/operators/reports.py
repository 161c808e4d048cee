"""Report aggregates: dashboards, distributions, conversion, concentration, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import exact_quantile, micros, ratio, running_totals

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
METRICS = ("item_view_count", "item_addtocart_count", "item_transaction_count", "unique_visitors", "product_interaction_score")


def kpis(events: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("event") == e).alias(n) for e, n in (("view", "n_views"), ("addtocart", "n_addtocart"), ("transaction", "n_transactions"))]
    own = events.agg(F.count("*").alias("n_events"), *counts, F.count_distinct("visitorid").alias("n_visitors"), F.count_distinct("itemid").alias("n_items"))
    return own.withColumn("conversion_rate", ratio(F.col("n_transactions"), F.col("n_views"))).withColumn("cart_abandonment_pct", 100 - 100 * ratio(F.col("n_transactions"), F.col("n_addtocart")))


def funnel(events: DataFrame) -> DataFrame:
    """event, n, pct of all events."""
    total = events.agg(F.count("*").alias("all"))
    return events.groupBy("event").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("event", "n", (100.0 * F.col("n") / F.col("all")).alias("pct"))


def top_categories(categories: DataFrame, n: int = 10) -> DataFrame:
    return categories.orderBy(F.desc("total_interactions"), "categoryid").limit(n)


def weekday_hours(events: DataFrame) -> DataFrame:
    """day, hour, n: all seven days by all hours that occur, 0 where nothing happened."""
    counts = events.groupBy(F.date_format("datetime", "EEEE").alias("day"), F.hour("datetime").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    days = F.explode(F.array(*map(F.lit, WEEKDAYS))).alias("day")
    return counts.select("hour").distinct().select("hour", days).join(counts, ["day", "hour"], "left").fillna(0, ["n"])


def by_weekday(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("datetime", "EEEE").alias("day")).agg(F.count("*").alias("n"))


def by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("datetime").cast("long").alias("hour")).agg(F.count("*").alias("n"), *[F.count_if(F.col("event") == e).alias(f"n_{e}") for e in ("view", "addtocart", "transaction")])


def daily(events: DataFrame) -> DataFrame:
    """day (ISO text), n: every day from the first to the last, also those without events."""
    counts = events.groupBy(F.to_date("datetime").alias("day")).agg(F.count("*").alias("n"))
    span = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """column, null_pct for each column, in one pass."""
    row = df.agg(*[(100.0 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_pct")) for c in df.columns])).alias("x")).select("x.*")


def head_share(counts: DataFrame, value: str, share: float, at_least: int = 0) -> DataFrame:
    """One row: the share of the total that the top ``share`` of rows have. Ranks run over distinct values with their counts, so
    rows need no global order; rows at the border count with the border's value."""
    values = running_totals(counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("rows")), "v", "rows", "before")
    total = values.agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("v")).alias("all")).withColumn("head", F.greatest(F.floor(F.col("n") * share), F.lit(at_least)).cast("long"))
    taken = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("head") - F.col("before")))
    return values.crossJoin(F.broadcast(total)).agg(F.first("n").alias("n_rows"), F.first("head").alias("n_head"), (F.sum(taken * F.col("v")) / F.first("all")).alias("head_share"))


def histogram(df: DataFrame, value: str, bins: int = 30, clip: float | None = None) -> DataFrame:
    """bin (from 1), n over equal bins between the least and the greatest value; the greatest belongs to the last bin."""
    x = F.col(value).cast("double")
    x = F.least(x, F.lit(clip)) if clip is not None else x
    v = df.select(x.alias("x")).where("x IS NOT NULL")
    ends = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))).cast("long")
    return v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def converting_items(events: DataFrame, min_views: int = 20, n: int = 10) -> DataFrame:
    """Items with enough views by purchases per view."""
    c = events.groupBy("itemid").agg(F.count_if(F.col("event") == "view").alias("views"), F.count_if(F.col("event") == "addtocart").alias("carts"), F.count_if(F.col("event") == "transaction").alias("purchases"))
    return c.where(F.col("views") >= min_views).withColumn("view_to_purchase", F.col("purchases") / F.col("views")).withColumn("cart_to_purchase", F.try_divide(F.col("purchases").cast("double"), F.col("carts").cast("double"))).orderBy(F.round("view_to_purchase", 9).desc(), "itemid").limit(n)


def repeat_visitors(events: DataFrame) -> DataFrame:
    """One row on visitors: how many come on several days, how many have one event, events each."""
    own = events.groupBy("visitorid").agg(F.count_distinct(F.to_date("datetime")).alias("days"), F.count("*").alias("n"))
    return own.agg(F.count("*").alias("n_visitors"), F.avg((F.col("days") > 1).cast("int")).alias("repeat_share"), F.avg((F.col("n") == 1).cast("int")).alias("single_event_share"), F.avg("n").alias("mean_events"), F.percentile("n", F.lit(0.5)).alias("median_events"))


def category_breadth(events: DataFrame, attributes: DataFrame) -> DataFrame:
    own = events.join(attributes.select("itemid", "categoryid"), "itemid", "left").groupBy("visitorid").agg(F.count_distinct("categoryid").alias("c"))
    return own.agg(F.avg("c").alias("mean_categories"), F.percentile("c", F.lit(0.5)).alias("median_categories"), F.avg((F.col("c") > 1).cast("int")).alias("several_share"))


def outliers(events: DataFrame, percentile: float = 0.99) -> DataFrame:
    """One row: the percentile of events per visitor, and how many visitors are above it."""
    own = events.groupBy("visitorid").agg(F.count("*").alias("n"))
    cap = exact_quantile(own, "n", percentile, "cap")
    return own.crossJoin(F.broadcast(cap)).agg(F.first("cap").alias("cap"), F.count_if(F.col("n") > F.col("cap")).alias("n_above"), F.max("n").alias("most"))


def zero_view_items(events: DataFrame, attributes: DataFrame) -> DataFrame:
    viewed = events.where("event = 'view'").select("itemid").distinct()
    return attributes.select("itemid").join(viewed, "itemid", "left_anti").agg(F.count("*").alias("n_zero_view"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many itemids two lists share, and their share of the first."""
    n = a.select("itemid").intersect(b.select("itemid")).agg(F.count("*").alias("n_shared"))
    return n.crossJoin(a.agg(F.count("*").alias("n"))).select("n_shared", ratio(F.col("n_shared"), F.col("n")).alias("share"))


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """Adds avg_rank: rank from the highest; equal values share the mean of their ranks. Distinct values are ranked."""
    counts = running_totals(df.groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_before")
    return df.join(counts.select(value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("avg_rank")), value)


def demo_visitors(users: DataFrame, n_top: int = 5, n_casual: int = 5, cold: int = 999_999_999, seed: int = 42) -> DataFrame:
    """The most active visitors, a seeded sample of casual ones (the first by a hash that any engine has), and an unknown one."""
    top = users.orderBy(F.round("user_activity_score", 9).desc(), "visitorid").limit(n_top).select("visitorid", F.lit("active").alias("kind"))
    casual = users.where("user_activity_score > 0.05 AND user_activity_score < 0.25").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("visitorid").cast("string"))), "visitorid").limit(n_casual).select("visitorid", F.lit("casual").alias("kind"))
    return top.unionByName(casual).unionByName(users.sparkSession.range(cold, cold + 1).select(F.col("id").alias("visitorid"), F.lit("cold").alias("kind")))


def recently_viewed(events: DataFrame, n: int = 10) -> DataFrame:
    """visitorid, rank, itemid: the latest distinct items of each visitor."""
    last = events.groupBy("visitorid", "itemid").agg(F.max("datetime").alias("at"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy("visitorid").orderBy(F.desc("at"), "itemid"))).where(F.col("rank") <= n).select("visitorid", "rank", "itemid")


def sorted_items(items: DataFrame, metric: str, n: int = 15) -> DataFrame:
    """Top items by one of the allowed metrics."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    return items.orderBy(F.round(metric, 9).desc(), "itemid").limit(n).select("itemid", F.col(metric).alias("value"))


def bounds(items: DataFrame) -> DataFrame:
    return items.agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min("itemid").alias("min_item"), F.max("itemid").alias("max_item"))


def category_values(items: DataFrame) -> DataFrame:
    return items.select("categoryid").dropna().distinct()


def quality_counters(raw: DataFrame, clean: DataFrame, sessions: DataFrame, attributes: DataFrame, tree: DataFrame, items: DataFrame) -> DataFrame:
    """One row of what each stage of preparation kept and lost."""
    parts = [
        raw.agg(F.count("*").alias("rows_raw")), clean.agg(F.count("*").alias("rows_clean")),
        sessions.agg(F.count("*").alias("n_sessions"), F.avg("n_events").alias("events_per_session")),
        attributes.agg(F.count_if(~F.col("has_category")).alias("no_category"), F.count_if(~F.col("has_price")).alias("no_price"), F.count_if(F.col("available") == 0).alias("unavailable")),
        tree.agg(F.count_if("is_root").alias("root_categories"), F.count_if(~F.col("is_root")).alias("child_categories")), items.agg(F.count_if("is_cold_start").alias("cold_items"), F.avg(F.col("is_cold_start").cast("int")).alias("cold_share")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.withColumn("rows_dropped", F.col("rows_raw") - F.col("rows_clean"))


def sparsity(matrix: DataFrame) -> DataFrame:
    """One row: users, items, pairs, and the share of the matrix that is empty."""
    return matrix.agg(F.count_distinct("visitorid").alias("n_users"), F.count_distinct("itemid").alias("n_items"), F.count("*").alias("n_pairs")).withColumn("sparsity", 1 - F.col("n_pairs") / (F.col("n_users") * F.col("n_items")))


def labels(items: DataFrame) -> DataFrame:
    """itemid, label, price_text for display."""
    return items.select("itemid", F.concat(F.lit("Item "), F.col("itemid").cast("string"), F.when(F.col("categoryid").isNotNull(), F.concat(F.lit(" (category "), F.col("categoryid").cast("string"), F.lit(")"))).otherwise("")).alias("label"), F.when(F.col("price").isNotNull(), F.concat(F.lit("$"), F.format_number("price", 2))).otherwise("Price not available").alias("price_text"))


def confidence_scatter(users: DataFrame) -> DataFrame:
    return users.select("visitorid", F.expr("user_view_count + user_addtocart_count + user_purchase_count").alias("total_interactions"), "user_activity_score")


def confidence_of_buyers(targets: DataFrame, users: DataFrame) -> DataFrame:
    """One row: distribution of the raw activity score of visitors who bought in the test period."""
    own = targets.select("visitorid").distinct().join(users.select("visitorid", "user_activity_score"), "visitorid")
    return own.agg(F.count("*").alias("n"), F.avg("user_activity_score").alias("mean_score")).crossJoin(exact_quantile(own, "user_activity_score", 0.5, "median_score")).select("n", "median_score", "mean_score")


def popularity_collapse(recommended: DataFrame, matrix: DataFrame, events: DataFrame) -> DataFrame:
    """What a model recommends to the visitor of the greatest weight, with the popularity rank (1: most events; ties share the mean
    rank) of each item: a model that has collapsed onto popularity has small ranks only."""
    total = matrix.groupBy("visitorid").agg(F.sum("weight").alias("total"))
    most = total.agg(F.min(F.struct(-F.round("total", 9), F.col("visitorid").alias("visitorid"))).getField("visitorid").alias("visitorid"))
    ranks = average_rank(events.groupBy("itemid").agg(F.count("*").alias("n_events")), "n_events")
    return recommended.join(F.broadcast(most), "visitorid").join(ranks, "itemid").select("visitorid", "itemid", "score", "rank", "n_events", F.col("avg_rank").alias("popularity_rank"))


def known_items(items: DataFrame, matrix: DataFrame) -> DataFrame:
    """itemid, has_history: whether anybody has met an item of the catalog, so that co-interaction can say something about it."""
    met = matrix.select("itemid").distinct().withColumn("has_history", F.lit(True))
    return items.select("itemid").join(met, "itemid", "left").select("itemid", F.coalesce("has_history", F.lit(False)).alias("has_history"))


def events_span(events: DataFrame) -> DataFrame:
    return events.agg(F.min("datetime").alias("a"), F.max("datetime").alias("b")).select(micros(F.col("a")).alias("first_us"), micros(F.col("b")).alias("last_us"), F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("b", "yyyy-MM-dd").alias("last_day"))
