"""Nearest rows by cosine: the same lists as all pairs give, with few pairs of heavy columns made, and no large task for a hot one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cooccurrence as co
from tidemark.operators import vectors


def plain(rows, n, skip=()):
    keys, over = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    a = np.zeros((len(keys), len(over)))
    for k, o, w in rows:
        a[keys.index(k), over.index(o)] = w
    norm = np.sqrt((a * a).sum(1))
    a = a / np.where(norm > 0, norm, 1)[:, None]
    sims = a @ a.T
    out = {}
    for i, k in enumerate(keys):
        if k not in skip:
            found = sorted((-round(sims[i, j], 9), keys[j]) for j in range(len(keys)) if j != i and sims[i, j] > 1e-15)[:n]
            out |= {(k, x): -s for s, x in found}
    return out


@pytest.mark.parametrize("light", [1, 4, 12, 1000])
def test_same_lists_as_all_pairs(spark, light):
    rng = np.random.default_rng(light)
    rows = [(k, o, float(rng.integers(0, 9))) for k in range(60) for o in range(40) if rng.random() < (0.9 if o < 3 else 0.12)]
    rows += [(100, 0, 1.0), (101, 0, 2.0), (102, 99, 3.0)]
    m = spark.createDataFrame(rows, "itemid long, visitorid long, weight double")
    skip = spark.createDataFrame([(5,), (100,)], "k long")
    got = {(r.a, r.b): round(r.sim, 9) for r in co.nearest(m, "itemid", "visitorid", 7, skip, light).collect()}
    assert got == pytest.approx(plain(rows, 7, {5, 100}), abs=2e-9)


def test_few_pairs_of_a_hot_column(spark):
    """300 rows share a hot column with a small weight each, and have near neighbours elsewhere: of its 90,000 pairs few are made."""
    rows = [(k, 0, 0.05) for k in range(300)] + [(k, 1 + k // 5, 1.0 + k % 5) for k in range(300)]
    m = spark.createDataFrame(rows, "itemid long, visitorid long, weight double")
    assert {(r.a, r.b): round(r.sim, 9) for r in co.nearest(m, "itemid", "visitorid", 3, light=10).collect()} == pytest.approx(plain(rows, 3), abs=2e-9)
    unit = co.unit_rows(m, "itemid", "visitorid").where("o = 0").withColumn("m", F.lit(300))
    keys = unit.select("k", F.col("w").alias("h"), F.lit(0.9).alias("t"))
    assert co.heavy_products(unit, keys, 10).count() == 0
    every = co.heavy_products(unit, keys.withColumn("t", F.lit(1e-300)), 10)
    assert every.count() == 300 * 299
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("light", [1, 3, 10, 1000])
def test_rows_that_ask_another_table(spark, light):
    """Each asks for a number of its own; ids of both sides may be equal; many ask in one column."""
    rng = np.random.default_rng(light)
    index = [(k, o, float(rng.random())) for k in range(40) for o in range(12) if rng.random() < (1.0 if o < 2 else 0.2)]
    asking = [(k, o, float(rng.random()), 1 + k % 5) for k in range(70) for o in range(14) if rng.random() < (0.9 if o < 2 else 0.2)]
    a, b = np.zeros((70, 14)), np.zeros((40, 14))
    for k, o, w, _ in asking:
        a[k, o] = w
    for k, o, w in index:
        b[k, o] = w
    a, b = (x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None] for x in (a, b))
    sims = a @ b.T
    want = {(i, j): round(sims[i, j], 9) for i in range(70) for j in sorted(range(40), key=lambda j: (-round(sims[i, j], 9), j))[: 1 + i % 5] if sims[i, j] > 0}
    left = spark.createDataFrame([(k, o, float(a[k, o]), n) for k, o, _, n in asking], "k long, o long, w double, n int")
    right = spark.createDataFrame([(k, o, float(b[k, o])) for k, o, _ in index], "k long, o long, w double")
    got = {(r.a, r.b): round(r.sim, 9) for r in co.nearest_rows(right, light=light, asking=left).collect()}
    assert got == pytest.approx(want, abs=2e-9)


def test_content_lists_with_shared_tokens(spark):
    """Lists are the same whether tokens of all profiles are joined (light) or only finish scores (heavy); each list against all pairs."""
    rng = np.random.default_rng(3)
    tokens = [(1000 - i, t) for i in range(80) for t in ["all", f"half{i % 2}", f"t{rng.integers(12)}", f"u{rng.integers(4)}"]]
    fitted = vectors.ContentVectors.fit(spark.createDataFrame(tokens, "itemid long, token string"))
    rows = fitted.item_vectors().collect()
    items, names = sorted({r.itemid for r in rows}), sorted({r.token for r in rows})
    a = np.zeros((len(items), len(names)))
    for r in rows:
        a[items.index(r.itemid), names.index(r.token)] = r.w
    sims = np.round(a @ a.T, 9)
    want = {}
    for i, x in enumerate(items):
        order = sorted((j for j in range(len(items)) if j != i), key=lambda j: (-sims[i, j], items[j]))[:6]
        want |= {(x, k + 1): items[j] for k, j in enumerate(order)}
    history = [(v, int(i), 1.0 + v % 3) for v in range(9) for i in rng.choice(items, 1 + v, replace=False)]
    seen = spark.createDataFrame(history, "visitorid long, itemid long, weight double")
    recs = {}
    for v in range(9):
        x = sum(w * a[items.index(i)] for u, i, w in history if u == v)
        score = np.round(a @ x / np.sqrt(x @ x), 9)
        mine = {i for u, i, _ in history if u == v}
        order = sorted((j for j in range(len(items)) if items[j] not in mine), key=lambda j: (-score[j], items[j]))[:5]
        recs |= {(v, k + 1): items[j] for k, j in enumerate(order)}
    for light in (2, 9, 1000):
        content = vectors.ContentVectors(fitted.members, fitted.vectors, light)
        assert {(r.itemid, r["rank"]): r.similar_item for r in content.similar_items(6).collect()} == want
        some = spark.createDataFrame([(items[3],), (items[50],), (5,)], "itemid long")
        assert {(r.itemid, r["rank"]): r.similar_item for r in content.similar_items(6, some).collect()} == {k: v for k, v in want.items() if k[0] in (items[3], items[50])}
        assert {(r.visitorid, r["rank"]): r.itemid for r in content.recommend(seen, 5).collect()} == recs


def by_hand(rows, n, neighbours):
    """Recommendations of the nearest users, and those users, with plain loops."""
    users = sorted({r[0] for r in rows})
    row = {u: {o: w for k, o, w in rows if k == u} for u in users}
    length = {u: sum(w * w for w in row[u].values()) ** 0.5 for u in users}
    near, out = {}, {}
    for a in users:
        if sum(row[a].values()) < 3:
            continue
        sims = {b: sum(w * row[b].get(o, 0) for o, w in row[a].items()) / (length[a] * length[b]) for b in users if b != a and length[b]}
        for b in sorted((b for b in sims if sims[b] > 1e-15), key=lambda b: (-round(sims[b], 9), b))[:neighbours]:
            near[a, b] = sims[b]
        score = {}
        for b in (b for x, b in near if x == a):
            for o, w in row[b].items():
                score[o] = score.get(o, 0) + near[a, b] * w
        for o in sorted((o for o in score if o not in row[a]), key=lambda o: (-round(score[o], 9), o))[:n]:
            out[a, o] = score[o]
    return near, out


@pytest.mark.parametrize("columns", [12, 200])
def test_users_with_equal_rows(spark, columns):
    """Copies of users, more of a row than a list holds, rows of the same direction, users with too little or nothing; few columns (blocks of all pairs) and many."""
    rng = np.random.default_rng(columns)
    base = [(k, int(o), float(rng.integers(0, 6))) for k in range(14) for o in rng.choice(columns, 7, replace=False)]
    rows = [(k + 14 * c, o, w) for k, o, w in base for c in range(1 + 4 * (k % 3))] + [(k + 200, o, 2 * w) for k, o, w in base if k < 6] + [(300, 1, 1.0), (301, 1, 0.0)]
    m = spark.createDataFrame(rows, "visitorid long, itemid long, weight double")
    near, hoped = by_hand(rows, 4, 5)
    found = co.UserNeighbours(m, 5)
    assert found.matrix.select("visitorid").distinct().count() <= 22
    assert {(r.a, r.b): r.sim for r in found.pairs().collect()} == pytest.approx(near, abs=2e-9)
    assert {(r.visitorid, r.itemid): r.score for r in found.recommend(4).collect()} == pytest.approx(hoped, abs=1e-8)


def test_blocks_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(k, o, float(rng.integers(0, 4))) for k in range(90) for o in range(30) if rng.random() < 0.6]
    unit = co.unit_rows(spark.createDataFrame(rows, "k long, o long, weight double"), "k", "o")
    asks = unit.select("k").distinct().where("k % 4 > 0")
    for block in (16, 2048):
        got = {(r.a, r.b): round(r.sim, 9) for r in co.block_nearest(unit, 6, asks, block).collect()}
        assert got == pytest.approx(plain(rows, 6, {k for k in range(90) if k % 4 == 0}), abs=2e-9)


def test_equal_histories_are_answered_once(spark, monkeypatch):
    """Copies of visitors get the lists of the first, of the same length and exclusions; only distinct ones ask."""
    rng = np.random.default_rng(4)
    tokens = spark.createDataFrame([(i, t) for i in range(60) for t in {f"a{i % 7}", f"b{i % 11}", f"c{rng.integers(0, 9)}"}], "itemid long, token string")
    content = vectors.ContentVectors.fit(tokens)
    base = [(v, int(i), float(rng.integers(1, 4)), 3 + v % 2) for v in range(6) for i in rng.choice(60, 4, replace=False)]
    rows = [(v + 100 * c, i, w, n) for v, i, w, n in base for c in range(5)] + [(900, i, w, n + 1) for v, i, w, n in base if v == 0]
    history = spark.createDataFrame(rows, "visitorid long, itemid long, weight double, n int")
    first = history.where("visitorid < 100 OR visitorid = 900")
    barred = spark.createDataFrame([(1, i) for i in range(0, 60, 2)] + [(2, 777), (102, 778)], "visitorid long, itemid long")
    asked, plain_rows = [], vectors.nearest_rows
    monkeypatch.setattr(vectors, "nearest_rows", lambda index, **kw: asked.append(kw["asking"].select("k").distinct().count()) or plain_rows(index, **kw))

    def lists(found):
        out = {}
        for r in found.collect():
            out.setdefault(r.visitorid, []).append((r["rank"], r.itemid, round(r.score, 8)))
        return {v: sorted(x) for v, x in out.items()}

    got, alone = lists(content.recommend(history, exclude=barred)), lists(content.recommend(first, exclude=barred))
    assert asked == [8, 7] and len(got) == 31 and {v: got[v] for v in alone} == alone
    open_list = lists(content.recommend(first))
    for v in range(6):
        assert all(got[v + 100 * c] == (open_list if v == 1 else alone)[v] for c in range(1, 5)) and len(got[v]) == 3 + v % 2
    assert len(got[900]) == 4 and got[900][:3] == got[0] and not {i for _, i, _ in got[1]} & set(range(0, 60, 2))
    matrix = history.select("visitorid", "itemid", "weight").where("visitorid < 900")
    by_items = lists(co.recommend_by_items(matrix, 4))
    assert all(by_items.get(v + 100 * c) == by_items.get(v) for v in range(6) for c in range(1, 5)) and by_items
    once = matrix.where("visitorid < 100")  # five copies of all change no similarity
    assert lists(co.recommend_by_items(once, 4)) == {v: x for v, x in by_items.items() if v < 100}


def test_blocks_grow_with_coordinates(spark, monkeypatch):
    """Rows are sent to a few tasks however many there are, and a task multiplies them in parts; n-th ones that are equal over parts go by key."""
    rows = [(k, o, 1.0) for k in range(200) for o in range(10) if (k + o) % 5 < 3]
    unit = co.unit_rows(spark.createDataFrame(rows, "k long, o long, weight double"), "k", "o")
    dealt, each = [], co.each_of
    monkeypatch.setattr(co, "each_of", lambda n: dealt.append(n._jc.toString()) or each(n))
    hoped = plain(rows, 7, set())
    for cells, blocks in ((1 << 21, 8), (100, 12)):
        found = co.block_nearest(unit, 7, unit.select("k").distinct(), 16, cells)
        assert {(r.a, r.b): round(r.sim, 9) for r in found.collect()} == pytest.approx(hoped, abs=2e-9)
        assert dealt.pop() == str(blocks) and not dealt


def test_a_small_index_takes_no_shuffle_of_pairs(spark, monkeypatch):
    """Pairs of rows that ask and rows of a small index are added up and ranked where they are made."""
    monkeypatch.setattr(co, "ASKING", 50)
    rng = np.random.default_rng(6)
    index = spark.createDataFrame([(k, o, 0.3) for k in range(40) for o in range(8) if rng.random() < 0.5], "k long, o long, w double")
    asking = spark.createDataFrame([(a, o, 0.2, 3) for a in range(100, 160) for o in range(8) if rng.random() < 0.5], "k long, o long, w double, n int")
    lists = [sorted((r.a, r.b, round(r.sim, 9)) for r in co.nearest_rows(index, asking=asking).collect())]
    dealt = [x for x in co.nearest_rows(index, asking=asking)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(a" in x]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
    monkeypatch.setattr(co, "SMALL", 0)
    lists.append(sorted((r.a, r.b, round(r.sim, 9)) for r in co.nearest_rows(index, asking=asking).collect()))
    assert lists[0] == lists[1] and lists[0]


def test_items_lists_without_a_shuffle_of_scores(spark, monkeypatch):
    """With few neighbours to send, scores are added up and ranked by visitor at once; the lists are those of the other way and hold nothing seen, met with no weight or in part."""
    monkeypatch.setattr(co, "ASKING", 50)
    rng = np.random.default_rng(9)
    rows = [(v, int(i), float(rng.integers(0, 4))) for v in range(70) for i in rng.choice(25, 6, replace=False)] + [(3, 99, 0.0), (4, 99, 0.0)]
    matrix = spark.createDataFrame(rows, "visitorid long, itemid long, weight double")
    got = co.recommend_by_items(matrix, 4)
    assert not any("itemid" in x or "(b#" in x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)
    lists = sorted((r.visitorid, r["rank"], r.itemid, round(r.score, 8)) for r in got.collect())
    monkeypatch.setattr(co, "SMALL", 0)
    assert lists == sorted((r.visitorid, r["rank"], r.itemid, round(r.score, 8)) for r in co.recommend_by_items(matrix, 4).collect())
    assert lists and not {(v, i) for v, _, i, _ in lists} & {(v, i) for v, i, _ in rows}


def test_the_plan_of_the_hybrid_stays_small(spark, sf):
    """Its legs are written: the last plan reads them, and neither the clickstream's features nor the catalog's are planned in it again."""
    from tidemark.plans import catalogue

    for query, most in (("hybrid_explain", 150), ("hybrid_explain_seeded", 500)):  # 461 and 1,015 lines when it held all legs
        plan = catalogue.QUERIES[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan.splitlines()) < most


@pytest.mark.parametrize("query", ["hybrid_recs", "hybrid_seeded"])
def test_the_hybrid_shares_what_its_legs_start_from(spark, sf, monkeypatch, query):
    """Events, catalog and matrix are computed once and read by each step, and the legs' rows are dealt out by visitor only."""
    from tidemark.plans import catalogue

    made, write = [], catalogue.materialized
    monkeypatch.setattr(catalogue, "materialized", lambda df, name: made.append(name) or write(df, name))
    found = catalogue.QUERIES[query](spark, sf)
    assert sorted(made) == ["attributes", "events", "matrix", "tree"]
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "Exchange hashpartitioning" in x and "itemid" in x and "visitorid" in x]


def test_the_hybrid_of_visitors_of_their_own_lengths(spark):
    """A missing visitor gets nothing, one without history what is popular; lists are as long as is asked."""
    from tidemark.operators import blend
    from tidemark.operators.vectors import ContentVectors

    matrix = spark.createDataFrame([(v, i, 5.0) for v in range(6) for i in range(v, v + 4)] + [(None, 2, 5.0)], "visitorid long, itemid long, weight double")
    users = spark.createDataFrame([(v, v / 6) for v in range(6)] + [(None, 1.0)], "visitorid long, user_activity_score double")
    items = spark.createDataFrame([(i, i / 10) for i in range(10)], "itemid long, product_interaction_score double")
    content = ContentVectors.fit(spark.createDataFrame([(i, f"t{i % 3}") for i in range(10)], "itemid long, token string"))
    visitors = spark.createDataFrame([(0, 1), (1, 2), (1, 2), (5, 3), (9, 2), (None, 2)], "visitorid long, n int")
    for more in ({}, {"seed_item": 4}):
        got = sorted((r.visitorid, r["rank"], r.itemid, round(r.hybrid_score, 9), round(r.cf_confidence_used, 9)) for r in blend.recommend(visitors, users, items, matrix, content, **more).collect())
        assert [(v, k) for v, k, *_ in got] == [(0, 1), (1, 1), (1, 2), (5, 1), (5, 2), (5, 3), (9, 1), (9, 2)]
        assert {(v, c) for v, _, _, _, c in got} == {(0, 0.0), (1, round((1 / 6) ** 0.5, 9)), (5, round((5 / 6) ** 0.5, 9)), (9, 0.0)}
        assert more or [x[2:4] for x in got if x[0] == 9] == [(9, 0.15), (8, round(0.15 * 8 / 9, 9))]
