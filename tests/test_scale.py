"""Forms that large tables need: exact quantiles without one task, products by blocks, trees of any width."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scoring import exact_quantile, exact_quantiles, running_totals
from tidemark.operators import catalog, clickstream, cooccurrence, latent, profiles
from tidemark.plans import bindings
from tidemark.sources import synthetic
from tidemark.sources.files import load_all, shared_folder


@pytest.mark.parametrize("n", [0, 1, 2, 101, 150_000])
def test_exact_quantile(spark, n):
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000003)) / 7.0).alias("x"))
    values = np.array([r.x for r in df.collect()])
    for at in (0.0, 0.2, 0.5, 0.99, 1.0):
        got = exact_quantile(df, "x", at, "q").first().q
        assert (got is None) if n == 0 else got == pytest.approx(np.quantile(values, at))
    with_nulls = df.union(spark.createDataFrame([(None,)], "x double"))
    assert n == 0 or exact_quantile(with_nulls, "x", 0.5, "q").first().q == pytest.approx(np.quantile(values, 0.5))


def test_several_quantiles_in_two_scans(spark):
    df = spark.range(250_000).select((F.pmod(F.xxhash64("id"), F.lit(999_983)) / 7.0).alias("x"))
    values = np.array([r.x for r in df.collect()])
    at = [0.0, 0.2, 0.2, 0.4, 0.6, 0.99, 1.0]
    got = exact_quantiles(df, "x", at, [f"c{i}" for i in range(len(at))], extremes=True)
    row = got.first()
    assert list(row)[:-2] == pytest.approx(np.quantile(values, at).tolist()) and list(row)[-2:] == [values.min(), values.max()]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 3  # ends are used twice: a scan is planned once and reused


def test_ancestors_of_a_long_path_and_of_cycles(spark):
    deep = spark.range(5000).select(F.col("id").alias("categoryid"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parentid"))
    got = catalog.ancestors(spark.createDataFrame([(4999,), (77,), (-1,), (None,)], "categoryid long"), deep)
    assert {r.categoryid: (r.n, r.least, r.most) for r in got.groupBy("categoryid").agg(F.count("*").alias("n"), F.min("ancestor").alias("least"), F.max("ancestor").alias("most")).collect()} == {4999: (5000, 0, 4999), 77: (78, 0, 77), -1: (1, -1, -1)}
    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(10, 3), (11, 10), (20, 20), (30, 99)], "categoryid long, parentid long")
    found = {}
    for r in catalog.ancestors(ring, ring).collect():
        found.setdefault(r.categoryid, []).append(r.ancestor)
    assert all(sorted(found[i]) == list(range(7)) for i in range(7)) and sorted(found[11]) == [*range(7), 10, 11] and found[20] == [20] and sorted(found[30]) == [30, 99]


def test_cutoff_reaches_the_scan(spark, sf, tmp_path):
    from tidemark.operators import rankings

    log = spark.createDataFrame([(i, i % 5, "view") for i in range(100)], "s int, itemid long, event string").select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("s"))).alias("datetime"), "itemid", "event")
    log.write.parquet(f"{tmp_path}/log")
    got = rankings.recently_popular(spark.read.parquet(f"{tmp_path}/log"), spark.createDataFrame([(1, 2)], "itemid long, categoryid long"), days=7)
    assert {r.itemid: r.recent_interactions for r in got.collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert any("PushedFilters" in line and "datetime" in line and "GreaterThanOrEqual" in line for line in plan.splitlines()), plan


def test_running_totals_over_ranges(spark):
    rows = [(float(i * 2 % 1001), i % 5 + 1) for i in range(1001)] + [(None, 4)]
    counts = spark.createDataFrame(rows, "v double, n long").repartition(7)
    got = {r.v: r.before for r in running_totals(counts, "v", "n", "before").collect()}
    assert got == {v: sum(n for w, n in rows if w is not None and (v is None or w > v)) for v, _ in rows}
    assert running_totals(counts.where("false"), "v", "n", "before").count() == 0


def test_huge_basket_in_blocks(spark):
    basket = spark.range(230).select(F.lit(1).cast("long").alias("transactionid"), F.col("id").alias("itemid")).union(spark.createDataFrame([(2, 5), (2, 6), (3, 7)], "transactionid long, itemid long"))
    blocks = cooccurrence.basket_pairs(basket, 20)
    assert blocks.count() == 230 * 229 + 2 == blocks.distinct().count() + 2
    one, many = (sorted(map(tuple, cooccurrence.pair_counts(basket, b).collect())) for b in (1000, 20))
    assert one == many


def test_each_pair_is_counted_once(spark, tmp_path):
    """Purchases are shuffled once for all that reads baskets, and of two items one order only; counts are those of both orders, whatever the blocks. Items or transactions may be missing, lines come twice."""
    rng = np.random.default_rng(4)
    rows = [(int(t), int(i)) for t, i in zip(rng.integers(0, 25, 400), rng.integers(0, 30, 400), strict=True)] + [(3, 5), (3, 5), (None, 5), (None, 6), (4, None), (99, 1), (98, -7), (98, 7)]
    schema = "l_orderkey long, l_partkey long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey", "current_timestamp() AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    sets = {}
    for t, i in rows:
        if t is not None and i is not None:
            sets.setdefault(t, set()).add(i)
    want = {}
    for items in sets.values():
        for a in items:
            for b in items - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    basket = cooccurrence.baskets(bindings.purchases(spark, str(tmp_path)))
    n_item = {i: sum(i in x for x in sets.values()) for i in range(-7, 30)}
    for block in (3, 1000):
        got = {(r.item_a, r.item_b): (r.n_pair, r.n_item, r.confidence) for r in cooccurrence.pair_counts(basket, block).collect()}
        assert got == {(a, b): (n, n_item[a], n / n_item[a]) for (a, b), n in want.items()}
        assert {(r.item_a, r.item_b): r.n for r in cooccurrence.basket_pairs(basket, block).groupBy("item_a", "item_b").agg(F.count("*").alias("n")).collect()} == want
        assert all(r.item_a < r.item_b for r in cooccurrence.basket_pairs(basket, block, ordered=False).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = cooccurrence.pair_counts(basket)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum("Exchange hashpartitioning(l_orderkey" in x and "Reused" not in x for x in plan) == 1


def test_block_products(spark, monkeypatch):
    monkeypatch.setattr(latent, "BLOCK_ITEMS", 5)
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(7, 3)), rng.normal(size=(23, 3))
    seen = {i: sorted(rng.choice(23, i, replace=False).tolist()) for i in range(7)}
    users = spark.createDataFrame([(i, u[i].tolist(), seen[i]) for i in range(7)], "visitorid long, u array<double>, seen array<long>")
    items = spark.createDataFrame([(j, v[j].tolist()) for j in range(23)], "itemid long, v array<double>")
    got = {}
    for r in latent.block_products(users, items, 4).collect():
        got.setdefault(r.visitorid, []).append((r.score, r.itemid))
    for i in range(7):
        all_ = sorted(((float(u[i] @ v[j]), j) for j in range(23) if j not in seen[i]), reverse=True)[:4]
        assert [j for _, j in sorted(got[i], reverse=True)[:4]] == [j for _, j in all_]


def test_ancestors_of_a_wide_tree(spark):
    tree = spark.range(1, 2000).select(F.col("id").alias("categoryid"), F.when(F.col("id") > 1, F.lit(1).cast("long")).alias("parentid"))
    assert catalog.ancestors(tree, tree).count() == 1999 + 1998


def test_raw_files_round_trip(spark, tmp_path):
    synthetic.write_raw(spark, str(tmp_path), n=2000, users=100, items=50, categories=20)
    raw = load_all(spark, str(tmp_path))
    assert raw["events"].count() >= 2000 and raw["category_tree"].count() == 20
    assert raw["item_properties"].count() == synthetic.item_properties(spark, 50, 20).count()


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("Context", (), {"master": "spark://somewhere"})

    with pytest.raises(ValueError):
        shared_folder(Cluster())
    assert shared_folder(spark)


@pytest.mark.parametrize("days", [0.001, 0.02, 1, 400])
def test_sessions_over_slices(spark, days):
    """Slices shorter than a gap, and than a session, give the same numbers as one pass over a visitor's events."""
    rng = np.random.default_rng(8)
    rows = [(v, int(t), int(i), "view") for v in range(6) for t, i in zip(np.cumsum(rng.choice([0, 1, 600, 1799, 1800, 1801, 90_000], 60)) + 1_700_000_000, rng.integers(0, 9, 60), strict=True)]
    log = spark.createDataFrame(rows, "visitorid long, s long, itemid long, event string").withColumn("datetime", F.timestamp_seconds("s"))
    got = clickstream.sessions(log, slice_days=days)
    assert got.columns == [*log.columns, "session_seq", "session_id"]
    found = sorted((r.visitorid, r.s, r.itemid, r.session_seq, r.session_id) for r in got.collect())
    want, last, seq = [], {}, {}
    for v, t, i, _ in sorted(rows):
        seq[v] = seq.get(v, 0) + (v not in last or t - last[v] > 1800)
        last[v] = t
        want.append((v, t, i, seq[v], f"{v}_{seq[v]}"))
    assert found == want


def test_distinct_counts_without_expand(spark):
    events = spark.createDataFrame([(1, 10, "view"), (1, 10, "view"), (1, 11, "transaction"), (1, 12, "view"), (2, 99, "addtocart"), (2, 10, "other")], "visitorid long, itemid long, event string")
    attributes = spark.createDataFrame([(10, 5), (11, 5), (12, None)], "itemid long, categoryid long")
    got = profiles.visits(events, attributes)
    assert {r.visitorid: (r.unique_items_viewed, r.unique_categories_viewed, r.user_view_count, r.user_addtocart_count, r.user_purchase_count) for r in got.collect()} == {1: (3, 1, 3, 0, 1), 2: (2, 1, 0, 1, 0)}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_features_of_odd_rows_and_what_they_shuffle(spark):
    """Visitors, items and times may be missing and events come twice. Distinct pairs are shuffled without the sums, sessions by number, and events by slice once."""
    rows = [(1, 10, "view", 0), (1, 10, "view", 0), (1, 11, "transaction", 90_000), (1, None, "addtocart", 90_001), (1, 12, "view", None), (None, 10, "view", 5), (None, 11, None, 6), (2, 99, "view", None), (3, 10, "other", 7)]
    log = spark.createDataFrame(rows, "visitorid long, itemid long, event string, s long").withColumn("datetime", F.timestamp_seconds("s"))
    attributes = spark.createDataFrame([(10, 5), (11, 6), (12, None)], "itemid long, categoryid long")
    sessioned = clickstream.sessions(log)
    # what has no time starts a session before all others and is not there itself
    assert sorted((r.visitorid, r.s, r.itemid or 0, r.session_id) for r in sessioned.collect()) == [(1, 0, 10, "1_2"), (1, 0, 10, "1_2"), (1, 90_000, 11, "1_3"), (1, 90_001, 0, "1_3"), (3, 7, 10, "3_1")]
    users = profiles.user_features(log, clickstream.session_summary(sessioned), attributes)
    got = {r.visitorid: (r.user_view_count, r.user_addtocart_count, r.user_purchase_count, r.unique_items_viewed, r.unique_categories_viewed, r.n_sessions, r.avg_session_duration_sec, r.median_session_duration_sec) for r in users.collect()}
    assert got == {1: (3, 1, 1, 3, 2, 2, 0.5, 0.5), None: (1, 0, 0, 2, 2, None, None, None), 2: (1, 0, 0, 1, 0, None, None, None), 3: (0, 0, 0, 1, 1, 1, 0.0, 0.0)}
    plan = profiles.visits(log, attributes, ("last_seen", F.max("datetime")))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[visitorid#\d+L, itemid#\d+L\], \[visitorid#\d+L, itemid#\d+L\]", plan)
    seen = clickstream.session_summary(sessioned).select("visitorid", "session_id", "duration_sec")
    seen.collect()
    plan = [x for x in seen._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert not any("session_id" in x for x in plan)


def test_item_and_category_features_of_odd_rows(spark):
    rows = [(1, 10, "view", 0), (1, 10, "view", 0), (2, 10, "transaction", 5), (None, 10, "view", 6), (2, 11, "addtocart", 7), (2, None, "view", 8), (3, 77, "view", 9)]
    log = spark.createDataFrame(rows, "visitorid long, itemid long, event string, s long").withColumn("datetime", F.timestamp_seconds("s"))
    attributes = spark.createDataFrame([(10, 5), (11, 5), (12, 6), (13, None), (None, 5)], "itemid long, categoryid long")
    categories = profiles.category_features(log, attributes)
    assert [(r.categoryid, r.category_view_count, r.category_addtocart_count, r.category_transaction_count, r.num_items_in_category) for r in categories.collect()] == [(5, 3, 1, 1, 2)]
    items = profiles.item_features(log, attributes, categories)
    assert {r.itemid: (r.item_view_count, r.item_addtocart_count, r.item_transaction_count, r.unique_visitors, r.is_cold_start) for r in items.collect()} == {10: (3, 0, 1, 2, False), 11: (0, 1, 0, 1, False), 12: (0, 0, 0, 0, True), 13: (0, 0, 0, 0, True), None: (0, 0, 0, 0, True)}


def test_parts_of_shuffles_follow_the_tables(tmp_path):
    """Sessions of default settings get small parts; what a session was started with stays."""
    import subprocess
    import sys

    code = """
import sys
from pyspark.sql import SparkSession
from tidemark.plans import bindings
b = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
for a in sys.argv[2:]:
    b = b.config(*a.split("="))
s = b.getOrCreate()
bindings.table(s, sys.argv[1], "region")
print("got", *[s.conf.get("spark.sql.adaptive." + k) for k in ("coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes")])
"""
    for given, hoped in (([], "got 600 4194304"), (["spark.sql.adaptive.advisoryPartitionSizeInBytes=9000000"], "got 600 9000000")):
        done = subprocess.run([sys.executable, "-c", code, "/root/testdata/sf0.001", *given], capture_output=True, text=True, timeout=120)
        assert hoped in done.stdout, done.stderr[-2000:]


def test_tables_of_small_files_are_not_broadcast(tmp_path):
    """Of half a million rows that take little room in files: too many for the driver. Tables that are small are."""
    import subprocess
    import sys

    code = """
import sys
from pyspark.sql import SparkSession, functions as F
from tidemark.plans import bindings
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
bindings.table(s, sys.argv[1], "region")
s.range(500_000).select(F.pmod(F.xxhash64("id"), F.lit(9000)).alias("v"), F.pmod(F.xxhash64("id"), F.lit(77)).alias("i"), (F.col("id") % 3).cast("double").alias("w")).coalesce(1).write.parquet(sys.argv[2])
t = s.read.parquet(sys.argv[2])
small = s.range(30).select("id", (F.col("id") * 2).alias("v"))
small.coalesce(1).write.parquet(sys.argv[2] + "-small")
small = s.read.parquet(sys.argv[2] + "-small")
plans = [x._jdf.queryExecution().executedPlan().toString() for x in (t.join(t.select("v", F.col("i").alias("j")), "v"), t.join(small, "v"))]
import pathlib
print("got", sum(f.stat().st_size for f in pathlib.Path(sys.argv[2]).iterdir()) < 10 << 20, *["BroadcastHashJoin" in x for x in plans])
"""
    done = subprocess.run([sys.executable, "-c", code, "/root/testdata/sf0.001", f"{tmp_path}/rows"], capture_output=True, text=True, timeout=120)
    assert "got True False True" in done.stdout, done.stdout + done.stderr[-2000:]
