"""Offline evaluation: temporal split, targets, ranking metrics, coverage, novelty, diversity, reach, comparison of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EVAL_K, EVAL_PAD, MIN_TRAIN_INTERACTIONS, TEST_FRACTION
from ..functions.scoring import exact_quantile, micros, top_per
from .vectors import ContentVectors

METRICS = ["precision", "recall", "map", "mrr", "ndcg"]


def temporal_split(events: DataFrame, test_fraction: float = TEST_FRACTION) -> tuple[DataFrame, DataFrame]:
    """Events up to and after the exact quantile of time."""
    timed = events.withColumn("_us", micros(F.col("datetime")))
    cut = exact_quantile(timed, "_us", 1 - test_fraction, "_cut")
    marked = timed.crossJoin(F.broadcast(cut))
    return marked.where("_us <= _cut").drop("_us", "_cut"), marked.where("_us > _cut").drop("_us", "_cut")


def eval_targets(train: DataFrame, test: DataFrame, least: int = MIN_TRAIN_INTERACTIONS) -> DataFrame:
    """visitorid, itemid: what visitors with enough training events bought in the test period."""
    known = train.groupBy("visitorid").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return test.where("event = 'transaction'").join(known, "visitorid", "left_semi").select("visitorid", "itemid").distinct()


def evaluation_list(recommended: DataFrame, train_pairs: DataFrame, known_items: DataFrame, k: int = EVAL_K) -> DataFrame:
    """visitorid, itemid, rank: the first k recommendations that have events at all and are not in the visitor's training events."""
    kept = recommended.join(known_items.select("itemid").distinct(), "itemid", "left_semi").join(train_pairs.select("visitorid", "itemid").distinct(), ["visitorid", "itemid"], "left_anti")
    return top_per(kept.withColumnRenamed("rank", "_was"), ["visitorid"], [F.asc("_was")], k).select("visitorid", "itemid", "rank")


def list_lengths(visitors: DataFrame, train_pairs: DataFrame, k: int = EVAL_K) -> DataFrame:
    """visitorid, n: how many recommendations to ask for, so that k are left after training items are taken out."""
    seen = train_pairs.select("visitorid", "itemid").distinct().groupBy("visitorid").agg(F.count("*").alias("n"))
    return visitors.select("visitorid").distinct().join(seen, "visitorid", "left").select("visitorid", (F.coalesce("n", F.lit(0)) + k + EVAL_PAD).cast("int").alias("n"))


def user_metrics(lists: DataFrame, targets: DataFrame, k: int = EVAL_K) -> DataFrame:
    """visitorid and the five metrics for each target visitor; one with an empty list has zeros."""
    relevant = targets.groupBy("visitorid").agg(F.count("*").alias("n_relevant"))
    hits = lists.where(F.col("rank") <= k).join(targets, ["visitorid", "itemid"]).withColumn("hit", F.row_number().over(W.partitionBy("visitorid").orderBy("rank")))
    sums = hits.groupBy("visitorid").agg(F.count("*").alias("hits"), F.sum(F.col("hit") / F.col("rank")).alias("ap"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = F.lit(0.0)
    return relevant.join(sums, "visitorid", "left").select(
        "visitorid", F.coalesce(F.col("hits") / F.lit(float(k)), zero).alias("precision"), F.coalesce(F.col("hits") / F.col("n_relevant"), zero).alias("recall"),
        F.coalesce(F.col("ap") / F.least(F.col("n_relevant"), F.lit(k)), zero).alias("map"), F.coalesce(1.0 / F.col("first"), zero).alias("mrr"), F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
    )


def ranking_metrics(lists: DataFrame, targets: DataFrame, k: int = EVAL_K) -> DataFrame:
    return user_metrics(lists, targets, k).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS], F.count("*").alias("n_users_evaluated"))


def _of_targets(lists: DataFrame, targets: DataFrame) -> DataFrame:
    return lists.join(targets.select("visitorid").distinct(), "visitorid", "left_semi")


def catalog_coverage(lists: DataFrame, targets: DataFrame, known_items: DataFrame) -> DataFrame:
    shown = _of_targets(lists, targets).agg(F.count_distinct("itemid").alias("shown"))
    return shown.crossJoin(known_items.agg(F.count_distinct("itemid").alias("all"))).select(F.coalesce(F.try_divide(F.col("shown").cast("double"), F.col("all").cast("double")), F.lit(0.0)).alias("catalog_coverage"))


def novelty(lists: DataFrame, targets: DataFrame, train: DataFrame) -> DataFrame:
    """Mean surprisal of recommended items; an item without training events has a probability of 1e-9."""
    share = train.groupBy("itemid").agg(F.count("*").alias("n")).crossJoin(F.broadcast(train.agg(F.count("*").alias("all")))).select("itemid", (F.col("n") / F.col("all")).alias("p"))
    return _of_targets(lists, targets).join(share, "itemid", "left").agg(F.coalesce(F.avg(-F.log2(F.greatest(F.coalesce("p", F.lit(1e-9)), F.lit(1e-12)))), F.lit(0.0)).alias("novelty"))


def diversity(lists: DataFrame, targets: DataFrame, content: ContentVectors) -> DataFrame:
    """Mean over non-empty lists of 1 - mean content cosine of the pairs of a list; lists with fewer than two catalog items have 0.
    The sum over pairs comes from the length of the list's summed vector, without making pairs."""
    own = _of_targets(lists, targets)
    placed = own.join(content.members, "itemid")
    n = placed.groupBy("visitorid").agg(F.count("*").alias("n"))
    summed = placed.join(content.vectors, "profile").groupBy("visitorid", "token").agg(F.sum("w").alias("x")).groupBy("visitorid").agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
    score = F.when(F.col("n") >= 2, 1 - (F.col("xx") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return own.select("visitorid").distinct().join(n, "visitorid", "left").join(summed, "visitorid", "left").agg(F.coalesce(F.avg(F.coalesce(score, F.lit(0.0))), F.lit(0.0)).alias("diversity"))


def user_reach(lists: DataFrame, visitors: DataFrame) -> DataFrame:
    """Share of all visitors who get at least one recommendation."""
    served = lists.join(visitors, "visitorid", "left_semi").agg(F.count_distinct("visitorid").alias("served"))
    return served.crossJoin(visitors.agg(F.count_distinct("visitorid").alias("all"))).select(F.coalesce(F.try_divide(F.col("served").cast("double"), F.col("all").cast("double")), F.lit(0.0)).alias("user_reach"))


def evaluated(name: str, lists: DataFrame, targets: DataFrame, train: DataFrame, known_items: DataFrame, visitors: DataFrame, content: ContentVectors, k: int = EVAL_K) -> DataFrame:
    """One row: model and all its figures."""
    parts = [ranking_metrics(lists, targets, k), catalog_coverage(lists, targets, known_items), novelty(lists, targets, train), diversity(lists, targets, content), user_reach(lists, visitors)]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.select(F.lit(name).alias("model"), *METRICS, "catalog_coverage", "novelty", "diversity", "user_reach", "n_users_evaluated")


def compare(results: DataFrame, baseline: str = "popularity") -> DataFrame:
    """Models by NDCG with their lift over the baseline in percent; infinite where the baseline has none."""
    base = results.where(F.col("model") == baseline).select(F.col("ndcg").alias("base"))
    lift = F.when(F.col("base") > 0, (F.col("ndcg") - F.col("base")) / F.col("base") * 100).otherwise(F.lit(float("inf")))
    return results.crossJoin(F.broadcast(base)).withColumn("lift_percent", lift).drop("base").orderBy(*[F.round("ndcg", 9).desc(), F.asc("model")])


def narrative(compared: DataFrame, k: int = EVAL_K) -> DataFrame:
    """One row: what the comparison says, in a sentence on accuracy and one on the hybrid's trade of accuracy for coverage. Of equal
    models the first by name is the best."""
    best = compared.orderBy(F.round("ndcg", 9).desc(), "model").limit(1).alias("b")
    hybrid = compared.where("model = 'hybrid'").select(F.col("catalog_coverage").alias("hc"), F.col("user_reach").alias("hr"), F.col("ndcg").alias("hn"))
    said = F.format_string("Highest raw accuracy: '%s', NDCG@" + str(k) + "=%.4f (%+.0f%% against popularity), precision %.4f, recall %.4f, reach %.1f%%.", "model", "ndcg", "lift_percent", "precision", "recall", F.col("user_reach") * 100)
    trade = F.format_string(" Hybrid shows %.1f%% of the catalog against %.1f%%, reaches %.1f%% of users and keeps %.0f%% of that accuracy.", F.col("hc") * 100, F.col("catalog_coverage") * 100, F.col("hr") * 100, F.coalesce(F.try_divide("hn", "ndcg"), F.lit(0.0)) * 100)
    return best.crossJoin(hybrid).select(F.concat(said, F.when(F.col("model") != "hybrid", trade).otherwise("")).alias("explanation"))
