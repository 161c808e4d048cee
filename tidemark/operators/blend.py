"""Hybrid recommendations: collaborative, content and popularity scores weighed by confidence in each user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CF_METHODS, EXPLAIN_CONFIDENCE, HYBRID_OVERFETCH, HYBRID_WEIGHTS, TOP_K
from ..functions.scoring import by_score, top_per
from ..sources.files import materialized
from . import cooccurrence, latent, vectors
from .vectors import ContentVectors


def confidence(visitors: DataFrame, users: DataFrame) -> DataFrame:
    """visitorid, cf_confidence: root of the activity score; 0 for unknown visitors."""
    return visitors.select("visitorid").distinct().join(users.select("visitorid", "user_activity_score"), "visitorid", "left").select("visitorid", F.sqrt(F.coalesce("user_activity_score", F.lit(0.0))).alias("cf_confidence"))


def collaborative(matrix: DataFrame, method: str, who: DataFrame) -> DataFrame:
    """Candidates of a method for users with list lengths of their own (visitorid, n)."""
    if method not in CF_METHODS:
        raise ValueError(f"cf_method must be one of {CF_METHODS}, got {method!r}")
    if method == "item_based":
        return cooccurrence.recommend_by_items(matrix, users=who)
    most = who.agg(F.max("n")).first()[0] or 1
    found = cooccurrence.recommend_by_users(matrix, most) if method == "user_based" else latent.recommend(matrix, most)
    return found.join(who, "visitorid").where(F.col("rank") <= F.col("n")).drop("n")


def recommend(visitors: DataFrame, users: DataFrame, items: DataFrame, matrix: DataFrame, content: ContentVectors, n: int = TOP_K, seed_item: int | None = None, cf_method: str = "item_based", weights: dict[str, float] = HYBRID_WEIGHTS) -> DataFrame:
    """visitorid, itemid, hybrid_score, cf_confidence_used, rank for all ``visitors`` (visitorid, optionally n).

    Each source brings three times as many candidates as are asked for. Content candidates are those near ``seed_item``, or else
    near the visitor's item of the highest id; a seed outside the catalog brings none. Seen items are not excluded.
    """
    who = visitors.select("visitorid", (F.col("n") if "n" in visitors.columns else F.lit(n)).alias("n")).dropDuplicates(["visitorid"])
    # the legs are written each: some are read twice, and the driver needn't hold and plan all of them at once
    who = materialized(who.join(confidence(who, users), "visitorid"), "confidence")
    wide = who.select("visitorid", (F.col("n") * HYBRID_OVERFETCH).alias("n"))
    cf = materialized(collaborative(matrix, cf_method, wide.join(matrix.select("visitorid").distinct(), "visitorid", "left_semi")).select("visitorid", "itemid", "score"), "collaborative")
    most = HYBRID_OVERFETCH * n if "n" not in visitors.columns else wide.agg(F.max("n")).first()[0] or 1
    if seed_item is not None:
        seeds = wide.withColumn("itemid", F.lit(seed_item).cast("long"))
    else:
        seeds = matrix.groupBy("visitorid").agg(F.max("itemid").alias("itemid")).join(wide, "visitorid")
    near = materialized(content.similar_items(most, seeds), "near")
    part_content = seeds.join(near, "itemid").where(F.col("rank") <= F.col("n")).select("visitorid", F.col("similar_item").alias("itemid"), (weights["content"] * F.col("content_similarity")).alias("s"))
    popular = items.orderBy(*by_score("product_interaction_score", "itemid")).limit(int(most)).select("itemid", "product_interaction_score")
    popular = top_per(popular.withColumn("one", F.lit(1)), ["one"], by_score("product_interaction_score", "itemid"), int(most), "place")
    best = popular.agg(F.max("product_interaction_score").alias("best"))
    part_popular = wide.join(F.broadcast(materialized(popular.crossJoin(best), "popular")), F.col("place") <= F.col("n")).select("visitorid", "itemid", (weights["popularity"] * F.col("product_interaction_score") / F.when(F.col("best") == 0, 1.0).otherwise(F.col("best"))).alias("s"))
    # the legs' rows, a few times n a visitor, are dealt out by visitor once: confidence, sums and ranks are all made there
    parts = cf.unionByName(part_content, allowMissingColumns=True).unionByName(part_popular, allowMissingColumns=True).repartition("visitorid").join(who, "visitorid")
    top = F.max("score").over(W.partitionBy("visitorid"))
    part_cf = weights["cf"] * F.col("cf_confidence") * F.col("score") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))
    total = parts.withColumn("top", top).groupBy("visitorid", "itemid", "n", "cf_confidence").agg(F.sum(F.coalesce("s", part_cf)).alias("hybrid_score"))
    ranked = top_per(total, ["visitorid"], by_score("hybrid_score", "itemid"), F.col("n"))
    return ranked.select("visitorid", "itemid", "hybrid_score", F.col("cf_confidence").alias("cf_confidence_used"), "rank")


def explained(recommended: DataFrame, seed_item: int | None = None, items: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """Adds the sentence: with a seed, what the item has in common with it (``items`` and ``tree`` of the catalog tell), else which signal counted."""
    if seed_item is not None:
        pairs = recommended.select(F.lit(seed_item).cast("long").alias("item_a"), F.col("itemid").alias("item_b")).distinct()
        why = vectors.explain(pairs, items, tree).select(F.col("item_b").alias("itemid"), "explanation")
        return recommended.join(why, "itemid")
    return recommended.withColumn("explanation", F.when(F.col("cf_confidence_used") > EXPLAIN_CONFIDENCE, "Recommended based on your browsing and purchase history.").otherwise("Recommended because it's popular among shoppers with similar interests."))
