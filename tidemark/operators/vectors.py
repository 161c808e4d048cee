"""Content vectors: token rows, TF-IDF, cosine neighbours and user profiles.

Items with the same tokens have the same vector. Vectors are kept for distinct token sets ("profiles"), which a catalog has few of,
and similarities are between profiles; ranked lists of items are filled from the members of profiles. So no join makes pairs of
items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PRICE_BUCKETS, TFIDF_MAX_FEATURES, TOP_K
from ..functions.scoring import by_score, top_per
from ..sources.files import materialized
from .catalog import ancestors, with_price_bucket
from .cooccurrence import LIGHT, alike, nearest_rows


def item_tokens(items: DataFrame, tree: DataFrame, brand: str | None = None, q: int = PRICE_BUCKETS) -> DataFrame:
    """itemid, token: the category and all above it, the price bucket or its absence, and on demand the brand."""
    path = items.select("itemid", "categoryid").join(ancestors(items, tree), "categoryid").select("itemid", F.concat(F.lit("cat_"), F.col("ancestor").cast("string")).alias("token"))
    bucketed = with_price_bucket(items.select("itemid", "price"), q)
    price = bucketed.select("itemid", F.coalesce(F.concat(F.lit("price_q"), F.col("price_bucket").cast("string")), F.lit("price_unknown")).alias("token"))
    out = path.unionByName(price)
    if brand is not None:
        name = F.regexp_replace(F.lower(F.col(brand).cast("string")), r"[^\p{L}\p{N}_]+", "")
        out = out.unionByName(items.where(F.col(brand).isNotNull()).select("itemid", F.concat(F.lit("brand_"), name).alias("token")))
    return out


class ContentVectors:
    """members (itemid, profile) and vectors (profile, token, w); ``tables()`` can be saved and given back."""

    def __init__(self, members: DataFrame, vectors: DataFrame, light: int = LIGHT):
        self.members, self.vectors, self.light = members, vectors, light

    @classmethod
    def fit(cls, tokens: DataFrame, max_features: int = TFIDF_MAX_FEATURES) -> "ContentVectors":
        """tf * (ln((1 + N) / (1 + df)) + 1), each vector of length 1, over the tokens most frequent in the catalog."""
        sets = tokens.groupBy("itemid").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        members = sets.select("itemid", F.xxhash64(F.concat_ws(" ", "tokens")).alias("profile"), "tokens")
        members = materialized(members, "members")
        profiles = members.groupBy("profile").agg(F.count("*").alias("size"), F.any_value("tokens").alias("tokens"))
        tf = profiles.select("profile", "size", F.explode("tokens").alias("token")).groupBy("profile", "size", "token").agg(F.count("*").alias("tf"))
        vocabulary = tf.groupBy("token").agg(F.sum("size").alias("df"), F.sum(F.col("size") * F.col("tf")).alias("total")).orderBy(F.desc("total"), "token").limit(max_features)
        n = profiles.agg(F.sum("size").alias("n_items"))
        weighted = tf.join(F.broadcast(vocabulary), "token").crossJoin(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1.0 + F.col("n_items")) / (1.0 + F.col("df"))) + 1.0))
        norms = weighted.groupBy("profile").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        # a fitted model is used again and again: kept, not computed anew from the catalog's tree each time
        return cls(members.select("itemid", "profile"), materialized(weighted.join(norms, "profile").select("profile", "token", (F.col("x") / F.col("norm")).alias("w")), "vectors"))

    def tables(self) -> dict[str, DataFrame]:
        return {"content_members": self.members, "content_vectors": self.vectors}

    def item_vectors(self) -> DataFrame:
        return self.members.join(self.vectors, "profile").select("itemid", "token", "w")

    def _index(self) -> tuple[DataFrame, DataFrame]:
        """head, profile: a profile's first item; and rows (k, o, w) of vectors by head. Profiles in order of heads are in order of what fills a list first,
        so of equally near profiles the first n hold all items that a list of n can show."""
        heads = self.members.groupBy("profile").agg(F.min("itemid").alias("head"))
        return heads, self.vectors.join(heads, "profile").select(F.col("head").alias("k"), F.col("token").alias("o"), "w")

    def _first_members(self, n) -> DataFrame:
        return top_per(self.members, ["profile"], [F.asc("itemid")], n, "place")

    def similar_items(self, n: int = TOP_K, of: DataFrame | None = None) -> DataFrame:
        """itemid, similar_item, content_similarity, rank for every item, or those of ``of`` (itemid): the n most similar others.

        A profile's own and the n nearest others are enough. They are found without making all pairs that share a token: tokens of few profiles give
        thresholds, and tokens that many share only finish what may still reach them."""
        heads, index = self._index()
        only = None if of is None else self.members.join(of.select("itemid").distinct(), "itemid").join(heads, "profile").select(F.col("head").alias("k")).distinct()
        asking = index if only is None else index.join(only, "k", "left_semi")
        near = nearest_rows(index, n, self.light, only=only).union(asking.select("k", F.col("k").alias("same"), F.lit(1.0)).distinct())
        ids = [heads.select(F.col("head").alias(h), F.col("profile").alias(p)) for h, p in (("a", "pa"), ("b", "pb"))]
        similar = near.join(ids[0], "a").join(ids[1], "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"), "sim")
        # profiles that others with n + 1 items or more come before bring nothing: cut before items are filled in
        sizes = self.members.groupBy(F.col("profile").alias("b")).agg(F.count("*").alias("size"))
        scored = similar.withColumn("place_score", F.round("sim", 9)).join(sizes, "b")
        better = F.sum("size").over(W.partitionBy("a").orderBy(F.desc("place_score"))) - F.sum("size").over(W.partitionBy("a", "place_score"))
        wanted = scored.withColumn("better", better).where(F.col("better") <= n)
        filled = wanted.join(self._first_members(n + 1).select(F.col("profile").alias("b"), F.col("itemid").alias("similar_item")), "b")
        listed = top_per(filled, ["a"], by_score("sim", "similar_item"), n + 1)
        asked = self.members if of is None else self.members.join(of.select("itemid").distinct(), "itemid", "left_semi")
        own = asked.join(listed.select(F.col("a").alias("profile"), "similar_item", "sim", "rank"), "profile").where("itemid <> similar_item")
        return top_per(own.drop("rank"), ["itemid"], by_score("sim", "similar_item"), n).select("itemid", "similar_item", F.col("sim").alias("content_similarity"), "rank")

    def recommend(self, history: DataFrame, n=TOP_K, exclude: DataFrame | None = None) -> DataFrame:
        """history (visitorid, itemid, and optionally weight and, for a list length of each visitor's own, n) -> visitorid, itemid,
        score, rank: items by cosine with the mean of the vectors of a visitor's items, those neither among them nor in ``exclude``
        (visitorid, itemid)."""
        cols = set(history.columns)
        seeds = history.select("visitorid", "itemid", (F.col("weight") if "weight" in cols else F.lit(1.0)).alias("weight"), (F.col("n") if "n" in cols else F.lit(n)).alias("n")).dropDuplicates(["visitorid", "itemid"]).join(self.members.select("itemid"), "itemid", "left_semi")
        told = seeds.select("visitorid", F.lit(True).alias("seed"), "itemid", "weight", "n")
        if exclude is not None:  # of what is barred only known items take places
            known = exclude.select("visitorid", "itemid").distinct().join(self.members.select("itemid"), "itemid", "left_semi").join(seeds.select("visitorid").distinct(), "visitorid", "left_semi")
            told = told.unionByName(known.select("visitorid", F.lit(False).alias("seed"), "itemid", F.lit(None).alias("weight"), F.lit(None).alias("n")))
        # visitors with the same history, lengths and exclusions are answered once
        alikes, rows = alike(told)
        seeds = rows.where("seed").select("visitorid", "itemid", "weight", "n").join(self.members, "itemid")
        barred = rows.select("visitorid", "itemid").distinct()
        budget = seeds.groupBy("visitorid").agg(F.max("n").alias("n")).join(barred.groupBy("visitorid").agg(F.count("*").alias("n_seeds")), "visitorid")
        mean = seeds.groupBy("visitorid", "profile").agg(F.sum("weight").alias("weight")).join(self.vectors, "profile").groupBy("visitorid", "token").agg(F.sum(F.col("weight") * F.col("w")).alias("x"))
        norms = mean.groupBy("visitorid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        heads, index = self._index()
        asking = mean.join(norms.where("norm > 0"), "visitorid").join(budget, "visitorid").select(F.col("visitorid").alias("k"), F.col("token").alias("o"), (F.col("x") / F.col("norm")).alias("w"), (F.col("n") + F.col("n_seeds")).alias("n"))
        near = nearest_rows(index, light=self.light, asking=asking).select(F.col("a").alias("visitorid"), F.col("b").alias("head"), F.col("sim").alias("score"))
        scores = near.join(heads, "head").select("visitorid", "profile", "score").where("score > 0").withColumn("place_score", F.round("score", 9))
        sizes = self.members.groupBy("profile").agg(F.count("*").alias("size"))
        sized = scores.join(sizes, "profile").join(budget, "visitorid")
        better = F.sum("size").over(W.partitionBy("visitorid").orderBy(F.desc("place_score"))) - F.sum("size").over(W.partitionBy("visitorid", "place_score"))
        wanted = sized.withColumn("better", better).where(F.col("better") < F.col("n") + F.col("n_seeds"))
        most = budget.agg(F.max(F.col("n") + F.col("n_seeds")).alias("most"))
        first = top_per(self.members.crossJoin(F.broadcast(most)), ["profile"], [F.asc("itemid")], F.col("most"), "place").select("profile", "itemid", "place")
        filled = wanted.join(first, "profile").where(F.col("place") <= F.col("n") + F.col("n_seeds"))
        unseen = filled.join(barred, ["visitorid", "itemid"], "left_anti")
        best = top_per(unseen, ["visitorid"], by_score("score", "itemid"), F.col("n"))
        return alikes.join(best.withColumnRenamed("visitorid", "head"), "head").select("visitorid", "itemid", "score", "rank")


def category_jaccard(pairs: DataFrame, items: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs (item_a, item_b) with category_similarity: Jaccard of the sets of categories from theirs upwards; 0 without a category."""
    paths = ancestors(items, tree).groupBy("categoryid").agg(F.collect_set("ancestor").alias("path"))
    own = items.select("itemid", "categoryid").join(paths, "categoryid", "left").select("itemid", "path")
    both = pairs.join(own.select(F.col("itemid").alias("item_a"), F.col("path").alias("path_a")), "item_a", "left").join(own.select(F.col("itemid").alias("item_b"), F.col("path").alias("path_b")), "item_b", "left")
    shared = F.size(F.array_intersect("path_a", "path_b")) / F.size(F.array_union("path_a", "path_b"))
    return both.withColumn("category_similarity", F.when(F.col("path_a").isNull() | F.col("path_b").isNull(), 0.0).otherwise(shared)).drop("path_a", "path_b")


def explain(pairs: DataFrame, items: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs (item_a seen, item_b recommended) with a sentence that says why."""
    rated = category_jaccard(pairs, items, tree)
    price = items.select("itemid", "price")
    both = rated.join(price.select(F.col("itemid").alias("item_a"), F.col("price").alias("pa")), "item_a", "left").join(price.select(F.col("itemid").alias("item_b"), F.col("price").alias("pb")), "item_b", "left")
    reason = F.when(F.col("category_similarity") >= 0.99, "same category").when(F.col("category_similarity") > 0, "related category").otherwise("similar attributes")
    close = F.coalesce(F.try_divide(F.least("pa", "pb"), F.greatest("pa", "pb")) > 0.7, F.lit(False)) & F.col("pa").isNotNull() & F.col("pb").isNotNull()
    return both.withColumn("explanation", F.concat(F.lit("Recommended because it has "), reason, F.when(close, " and similar price range").otherwise(""), F.lit(" to an item you viewed."))).drop("pa", "pb")
