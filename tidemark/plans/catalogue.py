"""Every query by name. Each takes (spark, folder of tables) and gives a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blend, catalog, clickstream, cooccurrence, latent, profiles, rankeval, rankings, reports, vectors
from ..functions.scoring import micros
from ..config import MIN_INTERACTIONS
from ..sources.files import load_events, materialized, shared_folder
from . import bindings
from .oracle import ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL", "Shop"]

#: Items, users and categories that single-item queries ask for.
SEED_ITEM, CATEGORY = 5, 101


class Shop:
    """The bound tables and what follows from them, each lazily and once. ``log``: other events than all, as in an evaluation."""

    def __init__(self, spark: SparkSession, sf_dir: str, log: DataFrame | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, object] = {}
        if log is not None:
            self._made["events"] = log

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def events(self) -> DataFrame:
        return self._once("events", lambda: bindings.events(self.spark, self.sf_dir))

    @property
    def sessioned(self):
        return self._once("sessioned", lambda: clickstream.sessions(self.events))

    @property
    def sessions(self):
        return self._once("sessions", lambda: clickstream.session_summary(self.sessioned))

    @property
    def attributes(self):
        return self._once("attributes", lambda: catalog.item_attributes(bindings.property_log(self.spark, self.sf_dir)))

    @property
    def tree(self):
        return self._once("tree", lambda: catalog.category_tree(bindings.category_tree(self.spark, self.sf_dir)))

    @property
    def users(self):
        return self._once("users", lambda: profiles.user_features(self.events, self.sessions, self.attributes))

    @property
    def categories(self):
        return self._once("categories", lambda: profiles.category_features(self.events, self.attributes))

    @property
    def items(self):
        return self._once("items", lambda: profiles.item_features(self.events, self.attributes, self.categories))

    @property
    def matrix(self):
        return self._once("matrix", lambda: cooccurrence.interactions(self.events))

    @property
    def basket(self):
        return self._once("basket", lambda: cooccurrence.baskets(bindings.purchases(self.spark, self.sf_dir)))

    @property
    def tokens(self):
        return self._once("tokens", lambda: vectors.item_tokens(self.attributes, self.tree))

    @property
    def content(self) -> vectors.ContentVectors:
        return self._once("content", lambda: vectors.ContentVectors.fit(self.tokens))

    def visitors(self):
        return self.events.select("visitorid").distinct()

    def write(self, *names: str) -> None:
        """What several steps start from is computed once, written, and read by each."""
        for name in names:
            self._made[name] = materialized(getattr(self, name), name)


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _plain(df: DataFrame) -> DataFrame:
    """Doubles to six digits, times as microseconds, counts as long: comparable in any engine."""
    out = []
    for name, kind in df.dtypes:
        out.append(_r(name) if kind == "double" else micros(F.col(name)).alias(name) if kind.startswith("timestamp") else F.col(name).cast("long").alias(name) if kind == "int" else F.col(name))
    return df.select(*out)


class Evaluation:
    """Training part, targets, and every model's lists, from training events only."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        whole = Shop(spark, sf_dir)
        train, self.test = rankeval.temporal_split(whole.events)
        self.train = materialized(train, "train")
        self.shop = Shop(spark, sf_dir, self.train)
        self.shop.write("attributes", "tree", "items", "users", "matrix")
        self.targets = materialized(rankeval.eval_targets(self.train, self.test), "targets")
        self.known = whole.events.select("itemid").distinct()
        self.visitors = whole.visitors()
        self.pairs = self.train.select("visitorid", "itemid").distinct()
        self.lengths = rankeval.list_lengths(self.visitors, self.pairs)

    def content(self) -> vectors.ContentVectors:
        """Fitted once; only the models and figures that use it pay for it."""
        if "content" not in self.shop._made:
            fitted = vectors.ContentVectors.fit(self.shop.tokens)
            self.shop._made["content"] = vectors.ContentVectors(materialized(fitted.members, "members"), materialized(fitted.vectors, "vectors"))
        return self.shop.content

    def lists(self, model: str) -> DataFrame:
        s, k = self.shop, 10
        if model == "popularity":
            most = self.lengths.agg(F.max("n")).first()[0] or 1
            ranked = rankings.trending(s.items, most).withColumn("rank", F.row_number().over(_w("product_interaction_score")))
            found = self.lengths.join(F.broadcast(ranked), F.col("rank") <= F.col("n")).select("visitorid", "itemid", "rank")
        elif model == "content":
            found = self.content().recommend(self.pairs.join(self.lengths, "visitorid"))
        elif model == "cf_item":
            found = cooccurrence.recommend_by_items(s.matrix, k)
        elif model == "cf_user":
            found = cooccurrence.recommend_by_users(s.matrix, k)
        elif model == "cf_svd":
            found = latent.recommend(s.matrix, k)
        elif model == "hybrid":
            found = blend.recommend(self.lengths, s.users, s.items, s.matrix, self.content())
        else:
            raise ValueError(f"unknown model {model!r}")
        return rankeval.evaluation_list(found, self.pairs, self.known, k)

    def row(self, model: str) -> DataFrame:
        # a list is used by five figures: computed once
        lists = materialized(self.lists(model), "lists")
        return rankeval.evaluated(model, lists, self.targets, self.train, self.known, self.visitors, self.content())


def _w(score: str):
    from pyspark.sql import Window as W

    return W.orderBy(F.round(score, 9).desc(), F.asc("itemid"))


MODELS = ("popularity", "content", "cf_item", "cf_user", "cf_svd", "hybrid")


def q(f):
    """A query from a function of the shop."""
    return lambda spark, sf_dir: _plain(f(Shop(spark, sf_dir)))


def _metric(model: str):
    def run(spark, sf_dir):
        e = Evaluation(spark, sf_dir)
        return _plain(rankeval.ranking_metrics(e.lists(model), e.targets))

    return run


def _figure(f):
    def run(spark, sf_dir):
        e = Evaluation(spark, sf_dir)
        return _plain(f(e, materialized(e.lists("cf_item"), "lists")))

    return run


def _comparison(spark, sf_dir, models=MODELS) -> DataFrame:
    e = Evaluation(spark, sf_dir)
    # one row a model: figures, not lists, come to the driver, and the comparison's plan stays small
    rows = [e.row(m).first() for m in models]
    return rankeval.compare(spark.createDataFrame(rows))


def _clean(spark, sf_dir):
    return _plain(clickstream.clean_events(bindings.raw_events(spark, sf_dir)))


def _csv(spark, sf_dir):
    """The clickstream written as CSV in the raw layout and loaded again."""
    e = bindings.events(spark, sf_dir)
    path = f"{shared_folder(spark)}/csv/events-{uuid.uuid4().hex}"
    e.select(F.unix_millis("datetime").alias("timestamp"), "visitorid", "event", "itemid", "transactionid").write.option("header", True).csv(path)
    return load_events(spark, path).select("timestamp", "visitorid", "event", "itemid", "transactionid")


def _exclusions(matrix: DataFrame, least_user: float, least_item: float) -> DataFrame:
    users, items = cooccurrence.excluded(matrix, "visitorid", least_user), cooccurrence.excluded(matrix, "itemid", least_item)
    return users.select(F.lit("user").alias("kind"), F.col("visitorid").alias("id"), "total").unionByName(items.select(F.lit("item").alias("kind"), F.col("itemid").alias("id"), "total"))


def _quality(spark, sf_dir):
    s = Shop(spark, sf_dir)
    raw = bindings.raw_events(spark, sf_dir)
    return _plain(reports.quality_counters(raw, clickstream.clean_events(raw), s.sessions, s.attributes, s.tree, s.items))


def _explained_pairs(s: Shop) -> DataFrame:
    near = s.content.similar_items(3).select(F.col("itemid").alias("item_a"), F.col("similar_item").alias("item_b"))
    return vectors.explain(near, s.attributes, s.tree)


def _hybrid(s: Shop, **kw) -> DataFrame:
    s.write("events", "attributes", "tree", "matrix")
    return blend.recommend(s.visitors(), s.users, s.items, s.matrix, s.content, **kw)


def _split(spark, sf_dir):
    train, test = rankeval.temporal_split(bindings.events(spark, sf_dir))
    return _plain(train.agg(F.lit("train").alias("part"), F.count("*").alias("n"), F.max("datetime").alias("last")).unionByName(test.agg(F.lit("test").alias("part"), F.count("*").alias("n"), F.max("datetime").alias("last"))))


def _targets(spark, sf_dir):
    return Evaluation(spark, sf_dir).targets


QUERIES = {
    # rankings
    "trending_topk": q(lambda s: rankings.trending(s.items, 10)),
    "trending_by_category": q(lambda s: rankings.trending(s.items, 10, category=CATEGORY)),
    "trending_excluding": q(lambda s: rankings.trending(s.items, 10, exclude=s.matrix.where("visitorid = 1"))),
    "best_sellers_topk": q(lambda s: rankings.best_sellers(s.items, 10)),
    "recently_popular_7d": q(lambda s: rankings.recently_popular(s.events, s.attributes, 10)),
    "product_search": q(lambda s: rankings.search(s.items, in_stock=True, price=(910.0, 1400.0)).select("itemid", "categoryid", "price", "item_view_count")),
    "product_search_category": q(lambda s: rankings.search(s.items, category=CATEGORY).select("itemid", "price", "item_view_count")),
    "point_lookup": q(lambda s: s.items.where(F.col("itemid") == SEED_ITEM).select("itemid", "categoryid", "item_view_count", "product_interaction_score")),
    # cleaning and structure
    "clean_events_dedup": _clean,
    "csv_round_trip": _csv,
    "txn_invariant": q(lambda s: clickstream.transaction_invariant(s.events)),
    "id_encoding": q(lambda s: clickstream.encode(s.events, "visitorid", "user_idx")),
    "item_id_encoding": q(lambda s: clickstream.encode(s.events, "itemid", "item_idx")),
    "sessions_assign": q(lambda s: s.sessioned.select("visitorid", "datetime", "session_seq", "session_id")),
    "sessions_summary": q(lambda s: s.sessions),
    "item_attributes_latest": q(lambda s: s.attributes),
    "category_tree_roots": q(lambda s: s.tree),
    "category_ancestors": q(lambda s: catalog.ancestors(s.tree, s.tree)),
    # features
    "user_features": q(lambda s: s.users),
    "category_features": q(lambda s: s.categories),
    "item_features": q(lambda s: s.items.withColumn("recency_days", F.when(F.col("recency_days") < float("inf"), F.col("recency_days")))),
    "popularity_rank": q(lambda s: s.items.select("itemid", "item_view_count", "popularity_rank")),
    # reports
    "dashboard_kpis": q(lambda s: reports.kpis(s.events)),
    "event_funnel": q(lambda s: reports.funnel(s.events)),
    "top_categories": q(lambda s: reports.top_categories(s.categories)),
    "heatmap_dow_hour": q(lambda s: reports.weekday_hours(s.events)),
    "events_by_dow": q(lambda s: reports.by_weekday(s.events)),
    "events_by_hour": q(lambda s: reports.by_hour(s.events)),
    "daily_volume": q(lambda s: reports.daily(s.events)),
    "quality_counters": _quality,
    "category_values": q(lambda s: reports.category_values(s.items)),
    "column_bounds": q(lambda s: reports.bounds(s.items)),
    "null_profile": q(lambda s: reports.null_profile(s.events)),
    "activity_concentration": q(lambda s: reports.head_share(s.events.groupBy("visitorid").agg(F.count("*").alias("n")), "n", 0.05)),
    "item_power_law": q(lambda s: reports.head_share(s.events.groupBy("itemid").agg(F.count("*").alias("n")), "n", 0.01, at_least=1)),
    "conversion_min_views": q(lambda s: reports.converting_items(s.events)),
    "repeat_visitors": q(lambda s: reports.repeat_visitors(s.events)),
    "category_breadth": q(lambda s: reports.category_breadth(s.events, s.attributes)),
    "outlier_p99": q(lambda s: reports.outliers(s.events)),
    "view_histogram": q(lambda s: reports.histogram(s.items, "item_view_count", 20)),
    "score_histogram": q(lambda s: reports.histogram(s.users, "user_activity_score", 30, clip=0.9)),
    "zero_view_items": q(lambda s: reports.zero_view_items(s.events, s.attributes)),
    "trending_bestseller_overlap": q(lambda s: reports.overlap(rankings.trending(s.items, 50), rankings.best_sellers(s.items, 50))),
    "demo_visitors": q(lambda s: reports.demo_visitors(s.users)),
    "known_items": q(lambda s: reports.known_items(s.items, s.matrix)),
    "avg_tie_rank": q(lambda s: reports.average_rank(s.items.select("itemid", "item_view_count"), "item_view_count")),
    "recently_viewed": q(lambda s: reports.recently_viewed(s.events)),
    "sorted_items": q(lambda s: reports.sorted_items(s.items, "unique_visitors")),
    "matrix_sparsity": q(lambda s: reports.sparsity(s.matrix)),
    "item_labels": q(lambda s: reports.labels(s.items)),
    "confidence_scatter": q(lambda s: reports.confidence_scatter(s.users)),
    "events_span": q(lambda s: reports.events_span(s.events)),
    # baskets
    "fbt_pairs": q(lambda s: cooccurrence.pair_counts(s.basket)),
    "fbt_topk": q(lambda s: cooccurrence.bought_together(cooccurrence.pair_counts(s.basket), 5)),
    "fbt_coverage": q(lambda s: cooccurrence.basket_coverage(s.basket)),
    # content
    "price_buckets": q(lambda s: catalog.with_price_bucket(s.attributes.select("itemid", "price"))),
    "tfidf_vectors": q(lambda s: s.content.item_vectors()),
    "content_similar_items": q(lambda s: s.content.similar_items(5)),
    "content_profile_recs": q(lambda s: s.content.recommend(s.matrix.select("visitorid", "itemid"), 10)),
    # barred: what comes next in the catalog to an item that a visitor has met
    "content_profile_excluding": q(lambda s: s.content.recommend(s.matrix.select("visitorid", "itemid"), 10, s.matrix.select("visitorid", (F.col("itemid") + 1).alias("itemid")))),
    "category_jaccard": q(lambda s: vectors.category_jaccard(s.content.similar_items(3).select(F.col("itemid").alias("item_a"), F.col("similar_item").alias("item_b")), s.attributes, s.tree)),
    "content_explain": q(_explained_pairs),
    "content_top1_similarity": q(lambda s: s.content.similar_items(1).groupBy(F.round("content_similarity", 6).alias("similarity")).agg(F.count("*").alias("n"))),
    # collaborative filtering
    "interaction_matrix": q(lambda s: s.matrix),
    "cf_exclusions": q(lambda s: _exclusions(s.matrix, MIN_INTERACTIONS, MIN_INTERACTIONS)),
    "cf_exclusions_high": q(lambda s: _exclusions(s.matrix, 40, 150)),
    "cf_item_similar": q(lambda s: cooccurrence.similar_items(s.matrix, 10)),
    "cf_item_recs": q(lambda s: cooccurrence.recommend_by_items(s.matrix, 10)),
    "cf_user_recs": q(lambda s: cooccurrence.recommend_by_users(s.matrix, 10)),
    "svd_recs": q(lambda s: latent.recommend(s.matrix, 10)),
    "svd_popularity": q(lambda s: reports.popularity_collapse(latent.recommend(s.matrix, 10), s.matrix, s.events)),
    "svd_explained_variance": q(lambda s: latent.explained_variance(s.matrix)),
    # hybrid
    "cf_confidence": q(lambda s: blend.confidence(s.visitors(), s.users)),
    "hybrid_recs": q(_hybrid),
    "hybrid_seeded": q(lambda s: _hybrid(s, seed_item=SEED_ITEM)),
    "hybrid_user_based": q(lambda s: _hybrid(s, cf_method="user_based")),
    "hybrid_svd": q(lambda s: _hybrid(s, cf_method="svd")),
    "hybrid_explain": q(lambda s: blend.explained(_hybrid(s)).select("visitorid", "itemid", "explanation")),
    "hybrid_explain_seeded": q(lambda s: blend.explained(_hybrid(s, seed_item=SEED_ITEM), SEED_ITEM, s.attributes, s.tree).select("visitorid", "itemid", "explanation")),
    # evaluation
    "temporal_split": _split,
    "eval_targets": _targets,
    **{f"ranking_metrics_{m}": _metric(m) for m in MODELS},
    "catalog_coverage": _figure(lambda e, x: rankeval.catalog_coverage(x, e.targets, e.known)),
    "novelty": _figure(lambda e, x: rankeval.novelty(x, e.targets, e.train)),
    "diversity": _figure(lambda e, x: rankeval.diversity(x, e.targets, e.content())),
    "user_reach": _figure(lambda e, x: rankeval.user_reach(x, e.visitors)),
    "buyer_confidence": _figure(lambda e, x: reports.confidence_of_buyers(e.targets, e.shop.users)),
    "model_comparison": lambda spark, sf_dir: _plain(_comparison(spark, sf_dir, [m for m in MODELS if m != "cf_svd"])),
    "narrative": lambda spark, sf_dir: rankeval.narrative(_comparison(spark, sf_dir, [m for m in MODELS if m != "cf_svd"])),
    "model_comparison_all": lambda spark, sf_dir: _plain(_comparison(spark, sf_dir)),
}
