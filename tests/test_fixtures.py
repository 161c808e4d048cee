"""Hand fixtures with values worked out by hand or by an independent small program."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scoring import coded_number, winsorized
from tidemark.operators import blend, catalog, clickstream, cooccurrence, latent, profiles, rankeval, reports, vectors
from tidemark.sources import files, synthetic
from tidemark.streaming.sessions import streaming_sessions

LOG = [
    (0, 1, "view", 10, None), (600, 1, "addtocart", 10, None), (2400, 1, "transaction", 10, 900), (2400, 1, "transaction", 20, 900), (4201, 1, "view", 30, None),
    (0, 2, "view", 20, None), (1209600, 2, "transaction", 20, 901), (1209600, 2, "transaction", 10, 901), (1209600, 2, "transaction", 30, 901), (1209600, 3, "wishlist", 30, None), (0, 1, "view", 10, None),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(datetime(1970, 1, 1) + timedelta(seconds=s), v, e, i, t) for s, v, e, i, t in LOG]
    return spark.createDataFrame(rows, "datetime timestamp, visitorid long, event string, itemid long, transactionid long")


@pytest.fixture(scope="module")
def log(raw):
    return clickstream.clean_events(raw).cache()


def test_duplicates_and_sessions(log):
    assert log.count() == 10
    s = clickstream.session_summary(clickstream.sessions(log))
    assert sorted((r.visitorid, r.session_id, r.n_events, r.duration_sec) for r in s.collect()) == [(1, "1_1", 4, 2400.0), (1, "1_2", 1, 0.0), (2, "2_1", 1, 0.0), (2, "2_2", 3, 0.0), (3, "3_1", 1, 0.0)]
    assert s.agg(F.sum("n_events")).first()[0] == log.count()
    assert streaming_sessions(log).count() == 5


def test_decayed_scores(spark, log):
    w = profiles.with_decayed_weight(log)
    items = {r.itemid: r.s for r in w.groupBy("itemid").agg(F.sum("weight").alias("s")).collect()}
    assert items == pytest.approx({10: 9.503956, 20: 8.003441, 30: 5.501205}, abs=1e-6)
    rows = spark.createDataFrame([(k, v) for k, v in items.items()] + [(40, 0.0)], "itemid long, raw double")
    assert {r.itemid: r.x for r in winsorized(rows, "raw", "x").collect()} == pytest.approx({10: 1.0, 20: 0.846124, 30: 0.581588, 40: 0.0}, abs=1e-6)


def test_winsorize_edges(spark):
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r.x for r in winsorized(same, "v", "x").collect()] == [0.0, 0.0]
    assert winsorized(same.where("v < 0"), "v", "x").count() == 0


def test_matrix_and_cosine(log):
    m = cooccurrence.interactions(log)
    assert {(r.visitorid, r.itemid): r.weight for r in m.collect()} == {(1, 10): 9, (1, 20): 5, (1, 30): 1, (2, 10): 5, (2, 20): 6, (2, 30): 5, (3, 30): 0}
    assert [r.visitorid for r in cooccurrence.excluded(m, "visitorid").collect()] == [3]
    assert cooccurrence.excluded(m, "itemid").count() == 0
    sims = {(r.a, r.b): r.sim for r in cooccurrence.nearest(m, "itemid", "visitorid", 100).where("a < b").collect()}
    assert sims == pytest.approx({(10, 20): 0.932703, (20, 30): 0.878853, (10, 30): 0.647648}, abs=1e-6)


def test_baskets(log):
    b = cooccurrence.baskets(log)
    got = cooccurrence.bought_together(cooccurrence.pair_counts(b)).where("item_a = 10").orderBy("rank").collect()
    assert [(r.item_b, r.n_pair, r.confidence) for r in got] == [(20, 2, 1.0), (30, 1, 0.5)]
    assert cooccurrence.basket_coverage(b).first().coverage == 1.0


def test_property_log(spark):
    rows = [(1, 10, "categoryid", "3"), (2, 10, "categoryid", "4"), (1, 10, "790", "n100.000"), (1, 10, "available", "0"), (1, 20, "categoryid", "x"), (1, 20, "790", "100"), (1, 30, "790", "n50.5"), (2, 30, "790", None), (1, 40, "zzz", "n1")]
    got = catalog.item_attributes(spark.createDataFrame(rows, "timestamp long, itemid long, property string, value string")).orderBy("itemid").collect()
    assert [tuple(r) for r in got] == [(10, 4, 0, True, 100.0, True), (20, None, 1, False, None, False), (30, None, 1, False, None, False)]


def test_coded_numbers(spark):
    df = spark.createDataFrame([("n12.5",), ("12.5",), ("nx",), ("n1d",), (None,), ("n-3",)], "v string")
    assert [r.x for r in df.select(coded_number(F.col("v")).alias("x")).collect()] == [12.5, None, None, None, None, -3.0]


def test_tree(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5)], "categoryid long, parentid long")
    seeds = spark.createDataFrame([(4,), (5,), (99,), (None,)], "categoryid long")
    got = {}
    for r in catalog.ancestors(seeds, tree).collect():
        got.setdefault(r.categoryid, set()).add(r.ancestor)
    assert got == {4: {4, 3, 2, 1}, 5: {5, 6}, 99: {99}}
    items = spark.createDataFrame([(1, 3), (2, 4), (3, 5), (4, None)], "itemid long, categoryid long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "item_a long, item_b long")
    assert [r.category_similarity for r in vectors.category_jaccard(pairs, items, tree).orderBy("item_a", "item_b").collect()] == [0.75, 0.0, 0.0]


def test_price_buckets(spark):
    items = spark.createDataFrame([(i, float(i)) for i in range(1, 12)] + [(12, None)], "itemid long, price double")
    assert [r.price_bucket for r in catalog.with_price_bucket(items).orderBy("itemid").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]


def test_ranking_metrics(spark):
    lists = [(1, i, r) for r, i in enumerate([1, 2, 3, 4, 5], 1)] + [(2, 7, 1), (2, 8, 2)] + [(3, i, i) for i in (1, 2, 3)]
    lists = spark.createDataFrame(lists, "visitorid long, itemid long, rank int")
    targets = spark.createDataFrame([(1, 2), (1, 5), (1, 9), (2, 7), (3, 4)], "visitorid long, itemid long")
    got = rankeval.ranking_metrics(lists, targets).first()
    assert [got[m] for m in ("precision", "recall", "map", "ndcg", "mrr")] == pytest.approx([0.1, 0.555556, 0.433333, 0.492541, 0.5], abs=1e-6)
    assert got.n_users_evaluated == 3


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 6, (12, 7)).astype(float)
    rows = [(u, i, float(a[u, i])) for u in range(12) for i in range(7) if a[u, i]]
    m = spark.createDataFrame(rows, "visitorid long, itemid long, weight double")
    got = {(r.visitorid, r.itemid): r.score for r in latent.recommend(m, 7, 3).collect()}
    u, s, v = np.linalg.svd(a, full_matrices=False)
    low = (u[:, :3] * s[:3]) @ v[:3]
    assert got == pytest.approx({k: low[k] for k in got}, abs=1e-8)
    assert set(got) == {(x, y) for x in range(12) for y in range(7) if not a[x, y] and a[x].sum() >= 3}
    assert 0 < latent.explained_variance(m, 3).agg(F.max("cumulative")).first()[0] <= 1 + 1e-9


def test_choices_are_checked(spark, log):
    m = cooccurrence.interactions(log)
    with pytest.raises(ValueError):
        blend.collaborative(m, "other", m)
    with pytest.raises(ValueError):
        reports.sorted_items(log, "nope")


def test_files_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    events = synthetic.events(spark, 500, 40, 30).cache()
    events.coalesce(1).write.option("header", True).csv(f"{folder}/events.csv")
    assert files.load_events(spark, f"{folder}/events.csv").drop("datetime").exceptAll(events).count() == 0
    with pytest.raises(FileNotFoundError):
        files.load_events(spark, f"{folder}/none.csv")
    with pytest.raises(ValueError, match="itemid"):
        files.require_columns(events.drop("itemid"), ["itemid"], "events")
    properties = synthetic.item_properties(spark, 30, 10)
    for i, part in enumerate(properties.randomSplit([0.5, 0.5], 1), 1):
        part.coalesce(1).write.option("header", True).csv(f"{folder}/item_properties_part{i}.csv")
    synthetic.category_tree(spark, 10, 2).coalesce(1).write.option("header", True).csv(f"{folder}/category_tree.csv")
    tables = files.load_all(spark, folder)
    assert tables["item_properties"].count() == properties.count() and tables["category_tree"].count() == 10
    files.save_tables({"m": events}, f"{folder}/model")
    assert files.load_tables(spark, f"{folder}/model", "m")["m"].count() == events.count()
    files.save_report(events.groupBy("event").count(), f"{folder}/report")
    assert files.load_report(spark, f"{folder}/report").count() == 3
    assert synthetic.with_baskets(events, properties, 1.0).count() > events.count()


def test_streaming_sessions(spark, log, tmp_path):
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    out = streaming_sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    out.awaitTermination(60)
    # those that the watermark has closed; a gap of exactly the limit ends a session window, so the first visitor's four events are three and one
    got = {(r.visitorid, r.n_events) for r in spark.table("sessions_out").collect()}
    assert got and {v for v, _ in got} <= {1, 2} and all(n <= 4 for _, n in got)


def test_diversity_without_pairs(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a"), (4, "b")], "itemid long, token string")
    c = vectors.ContentVectors.fit(tokens)
    v = {}
    for r in c.item_vectors().collect():
        v.setdefault(r.itemid, {})[r.token] = r.w
    cos = lambda x, y: sum(v[x].get(t, 0) * w for t, w in v[y].items())
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1)], "visitorid long, itemid long, rank int")
    targets = spark.createDataFrame([(1, 9), (2, 9)], "visitorid long, itemid long")
    want = (1 - (cos(1, 2) + cos(1, 3) + cos(2, 3)) / 3 + 0.0) / 2
    assert rankeval.diversity(lists, targets, c).first()[0] == pytest.approx(want)
    near = {(r.itemid, r.similar_item): r.content_similarity for r in c.similar_items(3).collect()}
    assert near == pytest.approx({(x, y): cos(x, y) for x in v for y in v if x != y and cos(x, y) > 0})
    assert math.isclose(near[(1, 4)], 1.0)


def test_saved_models_serve_what_fitted_ones_do(spark, sf, tmp_path):
    from tidemark.plans import catalogue, models

    models.train_and_save(spark, sf, f"{tmp_path}/m")
    served, shop = models.Recommender(spark, f"{tmp_path}/m"), catalogue.Shop(spark, sf)
    rows = lambda df: sorted((r.visitorid, r.itemid, r["rank"], round(r.score, 6)) for r in df.collect())
    assert rows(served.by_users(4)) == rows(cooccurrence.recommend_by_users(shop.matrix, 4))
    assert rows(served.by_factors(4)) == rows(latent.recommend(shop.matrix, 4))
    near = lambda df: sorted((r.itemid, r.similar_item, r["rank"]) for r in df.collect())
    assert near(served.similar(3)) == near(shop.content.similar_items(3))
    assert "content_vectors" not in served.similar(3)._jdf.queryExecution().executedPlan().toString()
    rounded = lambda df: sorted((r.visitorid, r.itemid, round(r.hybrid_score, 6)) for r in df.collect())
    assert rounded(served.recommend(shop.visitors())) == rounded(catalogue._hybrid(shop))
    assert served.trending(5).count() == 5 and served.bought_together(2).count() > 0 and served.also_viewed(2).count() > 0 and served.similar(2).count() > 0


def test_popularity_list_of_a_visitor_with_many_items(spark):
    from types import SimpleNamespace

    from tidemark.plans.catalogue import Evaluation

    e = Evaluation.__new__(Evaluation)
    items = spark.range(1200).select(F.col("id").alias("itemid"), F.lit(1).cast("long").alias("categoryid"), (2000.0 - F.col("id")).alias("product_interaction_score"))
    e.shop, e.known = SimpleNamespace(items=items), items.select("itemid")
    e.pairs = items.where("itemid < 1050").select(F.lit(1).cast("long").alias("visitorid"), "itemid")
    e.lengths = rankeval.list_lengths(spark.createDataFrame([(1,), (2,)], "visitorid long"), e.pairs)
    got = sorted((r.visitorid, r["rank"], r.itemid) for r in e.lists("popularity").collect())
    assert got == [(1, i + 1, 1050 + i) for i in range(10)] + [(2, i + 1, i) for i in range(10)]
