"""SVD against numpy: factors, lists, variance, and the queries that rest on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blend, cooccurrence, latent, rankeval, reports
from tidemark.plans.catalogue import Evaluation, Shop, QUERIES


def table(spark, a):
    return spark.createDataFrame([(u, i * 3 + 5, float(a[u, i])) for u in range(a.shape[0]) for i in range(a.shape[1]) if a[u, i]], "visitorid long, itemid long, weight double")


def dense(matrix):
    rows = matrix.collect()
    users, items = sorted({r.visitorid for r in rows}), sorted({r.itemid for r in rows})
    at, to = {u: i for i, u in enumerate(users)}, {x: j for j, x in enumerate(items)}
    a = np.zeros((len(users), len(items)))
    for r in rows:
        a[at[r.visitorid], to[r.itemid]] = r.weight or 1e-300  # met, if without weight
    return a, users, items


def lists(a, users, items, k, n, least=3.0):
    """Per user the n best unseen items by numpy's decomposition."""
    u, s, v = np.linalg.svd(a, full_matrices=False)
    k = min(k, a.shape[1] - 1)
    low = (u[:, :k] * s[:k]) @ v[:k]
    out = {}
    for i, who in enumerate(users):
        if a[i].sum() >= least:
            found = sorted((-round(low[i, j], 9) + 0.0, items[j], low[i, j]) for j in range(len(items)) if not a[i, j])[:n]
            out[who] = [(x, score) for _, x, score in found]
    return out


def compared(got, want):
    mine = {}
    for r in sorted(got, key=lambda r: (r.visitorid, r["rank"])):
        mine.setdefault(r.visitorid, []).append((r.itemid, r.score))
    assert mine.keys() == {u for u, x in want.items() if x}
    for who, found in mine.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in want[who]], abs=1e-5)
        # items may only change places where scores are as good as equal
        for (x, s), (y, t) in zip(found, want[who]):
            assert x == y or abs(s - t) < 1e-5


@pytest.mark.parametrize("shape, k, cells", [((40, 30), 4, 37), ((90, 70), 6, 500), ((6, 9), 50, 1 << 17), ((5, 2), 3, 3)])
def test_subspace_iteration(spark, monkeypatch, shape, k, cells):
    monkeypatch.setattr(latent, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(sum(shape))
    a = rng.integers(1, 9, shape) * (rng.random(shape) < 0.4)
    a[:, 0] = np.maximum(a[:, 0], 1)  # no empty columns
    a[:, :][:, a.sum(0) == 0] = 1
    m = table(spark, a.astype(float))
    a, users, items = dense(m)
    compared(latent.recommend(m, 5, k).collect(), lists(a, users, items, k, 5))
    u, s, v = np.linalg.svd(a, full_matrices=False)
    kept = min(k, a.shape[1] - 1, int((s > 1e-9).sum()))
    got = {r.factor: r for r in latent.explained_variance(m, k).collect()}
    x = (a @ v[:kept].T).var(axis=0) / a.var(axis=0).sum()
    assert [got[i].explained_variance_ratio for i in range(kept)] == pytest.approx(x.tolist(), abs=1e-7)
    assert got[kept - 1].cumulative == pytest.approx(x.sum(), abs=1e-6)


def test_rank_deficient_and_empty(spark):
    a = np.outer([1.0, 2, 3, 4], [1, 1, 2, 0, 3]) + np.outer([0, 1.0, 0, 2], [0, 2, 0, 5, 0])
    m = table(spark, a)
    v = np.array([r.v for r in latent.item_factors(m, 4).collect()])
    assert v.shape == (5, 2) and v.T @ v == pytest.approx(np.eye(2), abs=1e-9)
    assert latent.recommend(m.where("false"), 3).count() == 0 and latent.recommend(m.where("itemid = 5"), 3).count() == 0


def test_svd_queries_on_given_tables(spark, sf):
    shop = Shop(spark, sf)
    a, users, items = dense(shop.matrix)
    want = lists(a, users, items, 50, 10)
    compared(latent.recommend(shop.matrix, 10).collect(), want)
    # the visitor of the greatest weight, and mean ranks of items by events
    heavy = min(zip((-np.round(a.sum(1), 9)).tolist(), users))[1]
    n = {r.itemid: r.n for r in shop.events.groupBy("itemid").agg(F.count("*").alias("n")).collect()}
    mean_rank = {i: sum(x > n[i] for x in n.values()) + (sum(x == n[i] for x in n.values()) + 1) / 2 for i in n}
    got = sorted(QUERIES["svd_popularity"](spark, sf).collect(), key=lambda r: r["rank"])
    assert {r.visitorid for r in got} == {heavy} and [r.score for r in got] == pytest.approx([s for _, s in want[heavy]], abs=1e-6)
    assert all(r.popularity_rank == mean_rank[r.itemid] and r.n_events == n[r.itemid] for r in got)
    share = sorted(QUERIES["svd_explained_variance"](spark, sf).collect(), key=lambda r: r.factor)
    k = min(50, len(items) - 1)
    v = np.linalg.svd(a, full_matrices=False)[2][:k]
    assert [r.explained_variance_ratio for r in share] == pytest.approx(((a @ v.T).var(axis=0) / a.var(axis=0).sum()).tolist(), abs=1e-6)


def test_hybrid_and_metrics_by_svd(spark, sf):
    """Both equal what the same plans give when lists by numpy take the place of the factors'."""
    shop = Shop(spark, sf)
    a, users, items = dense(shop.matrix)
    most = 30
    rows = [(who, x, round(float(s), 9) + 0.0, k + 1) for who, found in lists(a, users, items, 50, most).items() for k, (x, s) in enumerate(found)]
    stub = spark.createDataFrame(rows, "visitorid long, itemid long, score double, rank int")
    original = latent.recommend
    mine = {(r.visitorid, r.itemid): r.hybrid_score for r in QUERIES["hybrid_svd"](spark, sf).collect()}
    latent.recommend = lambda matrix, n=10, factors=50: stub.where(F.col("rank") <= n)
    try:
        theirs = {(r.visitorid, r.itemid): r.hybrid_score for r in QUERIES["hybrid_svd"](spark, sf).collect()}
    finally:
        latent.recommend = original
    assert len(mine) == len(theirs) and sum(mine.values()) == pytest.approx(sum(theirs.values()), abs=1e-3)
    assert all(mine[key] == pytest.approx(theirs[key], abs=1e-5) for key in mine.keys() & theirs.keys()) and len(mine.keys() & theirs.keys()) >= 0.99 * len(mine)
    e = Evaluation(spark, sf)
    a, users, items = dense(e.shop.matrix)
    found = [(who, x, k + 1) for who, f in lists(a, users, items, 50, 10).items() for k, (x, _) in enumerate(f)]
    known = rankeval.evaluation_list(spark.createDataFrame(found, "visitorid long, itemid long, rank int"), e.pairs, e.known, 10)
    want = rankeval.ranking_metrics(known, e.targets).first().asDict()
    got = QUERIES["ranking_metrics_cf_svd"](spark, sf).first().asDict()
    assert {k: v for k, v in got.items() if isinstance(v, float)} == pytest.approx({k: want[k] for k in got if isinstance(got[k], float)}, abs=2e-3)


def test_the_matrix_is_made_once(spark):
    """What the matrix comes from is read once, however many steps follow."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    cells = spark.createDataFrame([(u, i, float(1 + (u * i) % 3)) for u in range(30) for i in range(12) if (u + i) % 3], "visitorid long, itemid long, weight double")
    assert latent.recommend(cells.mapInArrow(counted, cells.schema), 3, 4).count() == 90
    assert made.value == cells.count()
