"""The queries' results as SQL for DuckDB, put together from named common table expressions; only those a query needs are used."""

from __future__ import annotations

import re

HALF_LIFE_US = 14 * 86_400_000_000
WEIGHT = "CAST(CASE event WHEN 'view' THEN 1.0 WHEN 'addtocart' THEN 3.0 WHEN 'transaction' THEN 5.0 ELSE 0.0 END AS DOUBLE)"
DAY_US = "86400000000.0"


def _scaled(value: str, of: str) -> str:
    """Winsorized min-max scaling of a column of a relation, as an expression; constants come from scalar subqueries."""
    cap = f"(SELECT quantile_cont({value}, 0.99) FROM {of})"
    lo, hi = f"(SELECT min(least({value}, {cap})) FROM {of})", f"(SELECT max(least({value}, {cap})) FROM {of})"
    return f"CASE WHEN {hi} = {lo} THEN 0.0 ELSE (least({value}, {cap}) - {lo}) / ({hi} - {lo}) END"


BASE = {
    "allev": f"""SELECT CAST(user_id AS BIGINT) AS visitorid, CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid, ts AS datetime, epoch_us(ts) AS us, event_id FROM events""",
    "ptypes": "SELECT p_type, row_number() OVER (ORDER BY p_type) AS t FROM (SELECT DISTINCT p_type FROM part)",
    "pbrands": "SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS b FROM (SELECT DISTINCT p_brand FROM part)",
    "attrs": """SELECT p_partkey AS itemid, CAST(t * 100 + b AS BIGINT) AS categoryid, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS available, TRUE AS has_category,
        CASE WHEN p_partkey % 50 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12, 3)) AS DOUBLE) END AS price, p_partkey % 50 <> 0 AS has_price FROM part JOIN ptypes USING (p_type) JOIN pbrands USING (p_brand)""",
    "tree": "SELECT CAST(t AS BIGINT) AS categoryid, CAST(NULL AS BIGINT) AS parentid, TRUE AS is_root FROM ptypes UNION ALL SELECT DISTINCT CAST(t * 100 + b AS BIGINT), CAST(t AS BIGINT), FALSE FROM part JOIN ptypes USING (p_type) JOIN pbrands USING (p_brand)",
    "cut": "SELECT quantile_cont(us, 0.8) AS cut FROM allev",
    "trainev": "SELECT allev.* FROM allev, cut WHERE us <= cut",
    "testev": "SELECT allev.* FROM allev, cut WHERE us > cut",
    "anc": "SELECT categoryid, categoryid AS ancestor FROM tree UNION ALL SELECT categoryid, parentid FROM tree WHERE parentid IS NOT NULL",
    "basket": "SELECT DISTINCT l_orderkey AS tx, l_partkey AS itemid FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "fbt": """SELECT a.itemid AS item_a, b.itemid AS item_b, count(*) AS n_pair, max(c.n) AS n_item, count(*) / CAST(max(c.n) AS DOUBLE) AS confidence FROM basket a JOIN basket b ON a.tx = b.tx AND a.itemid <> b.itemid
        JOIN (SELECT itemid, count(*) AS n FROM basket GROUP BY itemid) c ON c.itemid = a.itemid GROUP BY a.itemid, b.itemid""",
    "cuts": "SELECT list_distinct(quantile_cont(price, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM attrs WHERE price IS NOT NULL",
    "bucketed": "SELECT itemid, price, CAST(CASE WHEN price IS NOT NULL THEN len(list_filter(cuts, lambda c: price > c)) END AS BIGINT) AS price_bucket FROM attrs, cuts",
    "tokens": "SELECT itemid, 'cat_' || ancestor AS token FROM attrs JOIN anc USING (categoryid) UNION ALL SELECT itemid, coalesce('price_q' || price_bucket, 'price_unknown') FROM bucketed",
    "idf": "SELECT token, ln((1.0 + (SELECT count(DISTINCT itemid) FROM tokens)) / (1.0 + count(DISTINCT itemid))) + 1.0 AS idf FROM tokens GROUP BY token",
    "tfidf": "SELECT itemid, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY itemid)) AS w FROM tokens JOIN idf USING (token)",
    # items of one token set share a vector: similarities between sets, then items
    "sets": "SELECT itemid, string_agg(token, ' ' ORDER BY token) AS p FROM tokens GROUP BY itemid",
    "setw": "SELECT p, token, min(w) AS w FROM tfidf JOIN sets USING (itemid) GROUP BY p, token",
    "setsim": "SELECT a.p AS pa, b.p AS pb, round(sum(a.w * b.w), 9) AS sim FROM setw a JOIN setw b USING (token) GROUP BY a.p, b.p",
    "known": "SELECT DISTINCT itemid FROM allev",
    "allusers": "SELECT DISTINCT visitorid FROM allev",
}
NEAR = """SELECT itemid, similar_item, sim AS content_similarity, rank FROM (
    SELECT x.itemid, y.itemid AS similar_item, sim, row_number() OVER (PARTITION BY x.itemid ORDER BY sim DESC, y.itemid) AS rank
    FROM {only} x JOIN setsim ON x.p = pa JOIN sets y ON y.p = pb WHERE x.itemid <> y.itemid) WHERE rank <= {n}"""


def shop(e: str, s: str) -> dict[str, str]:
    """Everything that follows from an event relation ``e``; names end in ``s``."""
    return {
        f"w{s}": f"SELECT *, {WEIGHT} * pow(0.5, ((SELECT max(us) FROM {e}) - us) / {float(HALF_LIFE_US)}) AS dw, {WEIGHT} AS w FROM {e}",
        f"gap{s}": f"SELECT *, CASE WHEN lag(us) OVER o IS NULL OR us - lag(us) OVER o > 1800000000 THEN 1 ELSE 0 END AS fresh FROM {e} WINDOW o AS (PARTITION BY visitorid ORDER BY us, itemid, event)",
        f"sess{s}": f"SELECT *, CAST(sum(fresh) OVER (PARTITION BY visitorid ORDER BY us, itemid, event ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM gap{s}",
        f"sessum{s}": f"""SELECT visitorid, visitorid || '_' || session_seq AS session_id, min(us) AS session_start, max(us) AS session_end, count(*) AS n_events, count(*) FILTER (WHERE event = 'view') AS n_views,
            count(*) FILTER (WHERE event = 'addtocart') AS n_addtocart, count(*) FILTER (WHERE event = 'transaction') AS n_transactions, (max(us) - min(us)) / 1000000.0 AS duration_sec FROM sess{s} GROUP BY visitorid, session_seq""",
        f"u0{s}": f"""SELECT visitorid, count(*) FILTER (WHERE event = 'view') AS user_view_count, count(*) FILTER (WHERE event = 'addtocart') AS user_addtocart_count, count(*) FILTER (WHERE event = 'transaction') AS user_purchase_count,
            count(DISTINCT w.itemid) AS unique_items_viewed, count(DISTINCT categoryid) AS unique_categories_viewed, min(us) AS first_seen, max(us) AS last_seen, sum(dw) AS activity_score_raw FROM w{s} w LEFT JOIN attrs ON attrs.itemid = w.itemid GROUP BY visitorid""",
        f"users{s}": f"""SELECT u.*, n_sessions, avg_session_duration_sec, median_session_duration_sec, ((SELECT max(us) FROM {e}) - last_seen) / {DAY_US} AS recency_days,
            coalesce(user_purchase_count / nullif(CAST(user_view_count AS DOUBLE), 0), 0) AS conversion_rate_user, coalesce(user_purchase_count / nullif(CAST(user_addtocart_count AS DOUBLE), 0), 0) AS click_to_purchase_ratio_user,
            {_scaled("activity_score_raw", f"u0{s}")} AS user_activity_score
            FROM u0{s} u JOIN (SELECT visitorid, count(*) AS n_sessions, avg(duration_sec) AS avg_session_duration_sec, quantile_cont(duration_sec, 0.5) AS median_session_duration_sec FROM sessum{s} GROUP BY visitorid) USING (visitorid)""",
        f"c0{s}": f"""SELECT categoryid, count(*) FILTER (WHERE event = 'view') AS category_view_count, count(*) FILTER (WHERE event = 'addtocart') AS category_addtocart_count, count(*) FILTER (WHERE event = 'transaction') AS category_transaction_count,
            count(*) FILTER (WHERE event IN ('view', 'addtocart', 'transaction')) AS total_interactions FROM {e} JOIN attrs USING (itemid) GROUP BY categoryid""",
        f"cats{s}": f"SELECT c.*, n AS num_items_in_category, {_scaled('total_interactions', f'c0{s}')} AS category_popularity_score FROM c0{s} c JOIN (SELECT categoryid, count(*) AS n FROM attrs GROUP BY categoryid) USING (categoryid)",
        f"i0{s}": f"""SELECT a.itemid, categoryid, available, has_category, price, has_price, coalesce(v, 0) AS item_view_count, coalesce(c, 0) AS item_addtocart_count, coalesce(t, 0) AS item_transaction_count, coalesce(uv, 0) AS unique_visitors, last_seen, coalesce(raw, 0.0) AS interaction_score_raw
            FROM attrs a LEFT JOIN (SELECT itemid, count(*) FILTER (WHERE event = 'view') AS v, count(*) FILTER (WHERE event = 'addtocart') AS c, count(*) FILTER (WHERE event = 'transaction') AS t, count(DISTINCT visitorid) AS uv, max(us) AS last_seen, sum(dw) AS raw FROM w{s} GROUP BY itemid) x ON x.itemid = a.itemid""",
        f"items{s}": f"""SELECT i.*, item_view_count + item_addtocart_count + item_transaction_count = 0 AS is_cold_start, ((SELECT max(us) FROM {e}) - last_seen) / {DAY_US} AS recency_days,
            coalesce(item_transaction_count / nullif(CAST(item_view_count AS DOUBLE), 0), 0) AS product_conversion_rate, coalesce(item_transaction_count / nullif(CAST(item_addtocart_count AS DOUBLE), 0), 0) AS click_to_purchase_ratio_item,
            {_scaled("interaction_score_raw", f"i0{s}")} AS product_interaction_score, rank() OVER (ORDER BY item_view_count DESC) AS popularity_rank, coalesce(category_popularity_score, 0.0) AS category_popularity_score
            FROM i0{s} i LEFT JOIN (SELECT categoryid, category_popularity_score FROM cats{s}) USING (categoryid)""",
        f"m{s}": f"SELECT visitorid, itemid, sum(w) AS weight FROM w{s} GROUP BY visitorid, itemid",
        f"xu{s}": f"SELECT visitorid, sum(weight) AS total FROM m{s} GROUP BY visitorid HAVING sum(weight) < 3",
        f"xi{s}": f"SELECT itemid, sum(weight) AS total FROM m{s} GROUP BY itemid HAVING sum(weight) < 3",
        f"ui{s}": f"SELECT visitorid, itemid, weight / sqrt(sum(weight * weight) OVER (PARTITION BY itemid)) AS w FROM m{s} WHERE weight > 0",
        f"uu{s}": f"SELECT visitorid, itemid, weight / sqrt(sum(weight * weight) OVER (PARTITION BY visitorid)) AS w FROM m{s} WHERE weight > 0",
        f"si{s}": f"SELECT a.itemid AS a, b.itemid AS b, sum(a.w * b.w) AS sim FROM ui{s} a JOIN ui{s} b USING (visitorid) GROUP BY a.itemid, b.itemid",
        f"su{s}": f"SELECT a.visitorid AS a, b.visitorid AS b, sum(a.w * b.w) AS sim FROM uu{s} a JOIN uu{s} b USING (itemid) GROUP BY a.visitorid, b.visitorid",
        f"ni{s}": f"SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, a <> b, b) AS near FROM si{s}",
        f"nu{s}": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, a <> b, b) AS near FROM su{s} WHERE a NOT IN (SELECT visitorid FROM xu{s})) WHERE near <= 21 AND a <> b",
        f"cfi{s}": cf_items("10", s),
        f"cfu{s}": cf_users(10, s),
        f"len{s}": f"SELECT visitorid, CAST(coalesce(c, 0) + 30 AS INTEGER) AS n FROM allusers LEFT JOIN (SELECT visitorid, count(DISTINCT itemid) AS c FROM {e} GROUP BY visitorid) USING (visitorid)",
        f"ask{s}": "SELECT visitorid, 10 AS n FROM allusers",
        f"conf{s}": f"SELECT visitorid, sqrt(coalesce(user_activity_score, 0.0)) AS cf_confidence FROM allusers LEFT JOIN users{s} USING (visitorid)",
        f"pop{s}": f"SELECT itemid, product_interaction_score AS sc, row_number() OVER (ORDER BY round(product_interaction_score, 9) DESC, itemid) AS place FROM items{s}",
        f"hyb{s}": hybrid(f"ask{s}", s),
        f"hybe{s}": hybrid(f"len{s}", s),
        f"pv{s}": f"SELECT visitorid, token, sum(w) AS x FROM (SELECT DISTINCT visitorid, itemid FROM {e}) JOIN tfidf USING (itemid) GROUP BY visitorid, token",
        f"ps{s}": f"SELECT visitorid, p, sum(x * w) / max(norm) AS score FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY visitorid)) AS norm FROM pv{s}) JOIN setw USING (token) GROUP BY visitorid, p",
        f"con{s}": content(f"ask{s}", e, s),
        f"cone{s}": content(f"len{s}", e, s),
    }


def content(ask: str, e: str, s: str) -> str:
    """A visitor's items rank first among the sets' members at most as often as there are of them, so these many more are looked at."""
    return f"""SELECT visitorid, itemid, score, rank FROM (SELECT visitorid, itemid, score, n, row_number() OVER (PARTITION BY visitorid ORDER BY round(score, 9) DESC, itemid) AS rank
        FROM ps{s} JOIN sets USING (p) JOIN {ask} USING (visitorid) WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM {e} x WHERE x.visitorid = ps{s}.visitorid AND x.itemid = sets.itemid)) WHERE rank <= n"""


def cf_items(n: str, s: str, ask: str = "") -> str:
    join = f"JOIN {ask} q ON q.visitorid = m.visitorid" if ask else ""
    return f"""SELECT visitorid, itemid, score, rank FROM (SELECT visitorid, itemid, score, n, row_number() OVER (PARTITION BY visitorid ORDER BY round(score, 9) DESC, itemid) AS rank FROM (
        SELECT m.visitorid, b AS itemid, max({n}) AS n, sum(weight * sim) AS score FROM m{s} m {join} JOIN ni{s} ON a = m.itemid WHERE near <= {n} + 5 AND m.visitorid NOT IN (SELECT visitorid FROM xu{s}) GROUP BY m.visitorid, b) c
        WHERE NOT EXISTS (SELECT 1 FROM m{s} x WHERE x.visitorid = c.visitorid AND x.itemid = c.itemid)) WHERE rank <= n"""


def cf_users(n: int, s: str) -> str:
    return f"""SELECT * FROM (SELECT visitorid, itemid, score, row_number() OVER (PARTITION BY visitorid ORDER BY round(score, 9) DESC, itemid) AS rank FROM (
            SELECT a AS visitorid, itemid, sum(sim * weight) AS score FROM nu{s} JOIN m{s} ON visitorid = b GROUP BY a, itemid) s WHERE NOT EXISTS (SELECT 1 FROM m{s} x WHERE x.visitorid = s.visitorid AND x.itemid = s.itemid)) WHERE rank <= {n}"""


def hybrid(ask: str, s: str, seed: str = "", cf: str = "") -> str:
    seeds = f"(SELECT visitorid, CAST({seed} AS BIGINT) AS itemid FROM {ask})" if seed else f"(SELECT visitorid, max(itemid) AS itemid FROM m{s} GROUP BY visitorid)"
    cf = cf or cf_items("3 * q.n", s, ask)
    only = f"(SELECT itemid, p FROM sets WHERE itemid IN (SELECT itemid FROM {seeds}))"
    near = NEAR.format(only=only, n=f"(SELECT 3 * max(n) FROM {ask})")
    return f"""SELECT visitorid, itemid, hybrid_score, cf_confidence AS cf_confidence_used, rank FROM (
      SELECT t.*, n, row_number() OVER (PARTITION BY visitorid ORDER BY round(hybrid_score, 9) DESC, itemid) AS rank FROM (
        SELECT visitorid, itemid, sum(x) AS hybrid_score FROM (
          SELECT visitorid, itemid, 0.6 * cf_confidence * score / coalesce(nullif(max(score) OVER (PARTITION BY visitorid), 0), 1.0) AS x FROM ({cf}) JOIN conf{s} USING (visitorid)
          UNION ALL SELECT visitorid, similar_item, 0.25 * content_similarity FROM {seeds} JOIN {ask} USING (visitorid) JOIN ({near}) USING (itemid) WHERE rank <= 3 * n
          UNION ALL SELECT visitorid, itemid, 0.15 * sc / coalesce(nullif((SELECT max(sc) FROM pop{s}), 0), 1.0) FROM {ask} JOIN pop{s} ON place <= 3 * n) GROUP BY visitorid, itemid) t
      JOIN {ask} USING (visitorid)) JOIN conf{s} USING (visitorid) WHERE rank <= n"""


def listed(found: str, e: str) -> str:
    return f"""SELECT visitorid, itemid, rank FROM (SELECT visitorid, itemid, row_number() OVER (PARTITION BY visitorid ORDER BY rank) AS rank FROM ({found}) f
        WHERE itemid IN (SELECT itemid FROM known) AND NOT EXISTS (SELECT 1 FROM {e} x WHERE x.visitorid = f.visitorid AND x.itemid = f.itemid)) WHERE rank <= 10"""


LISTS = {
    "popularity": listed("SELECT visitorid, itemid, place AS rank FROM len_t JOIN pop_t ON place <= n", "trainev"), "content": listed("SELECT * FROM cone_t", "trainev"),
    "cf_item": listed("SELECT * FROM cfi_t", "trainev"), "cf_user": listed("SELECT * FROM cfu_t", "trainev"), "hybrid": listed("SELECT * FROM hybe_t", "trainev"),
}
EVAL = {
    "targets": "SELECT DISTINCT visitorid, itemid FROM testev WHERE event = 'transaction' AND visitorid IN (SELECT visitorid FROM trainev GROUP BY visitorid HAVING count(*) >= 2)",
    **{f"l_{m}": x for m, x in LISTS.items()},
    **{
        f"k_{m}": f"""SELECT avg(p) AS "precision", avg(r) AS recall, avg(ap) AS map, avg(rr) AS mrr, avg(nd) AS ndcg, count(*) AS n_users_evaluated FROM (
        SELECT coalesce(hits, 0) / 10.0 AS p, coalesce(hits, 0) / CAST(n AS DOUBLE) AS r, coalesce(sp, 0) / least(n, 10) AS ap, coalesce(1.0 / first, 0) AS rr,
               coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0))) AS nd
        FROM (SELECT visitorid, count(*) AS n FROM targets GROUP BY visitorid) LEFT JOIN (
          SELECT visitorid, count(*) AS hits, sum(h / CAST(rank AS DOUBLE)) AS sp, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM (
            SELECT visitorid, rank, row_number() OVER (PARTITION BY visitorid ORDER BY rank) AS h FROM l_{m} JOIN targets USING (visitorid, itemid)) GROUP BY visitorid) USING (visitorid))"""
        for m in LISTS
    },
    **{f"o_{m}": f"SELECT * FROM l_{m} WHERE visitorid IN (SELECT visitorid FROM targets)" for m in LISTS},
    **{f"cov_{m}": f"SELECT count(DISTINCT itemid) / CAST((SELECT count(*) FROM known) AS DOUBLE) AS catalog_coverage FROM o_{m}" for m in LISTS},
    "share": "SELECT itemid, count(*) / CAST((SELECT count(*) FROM trainev) AS DOUBLE) AS p FROM trainev GROUP BY itemid",
    **{f"nov_{m}": f"SELECT coalesce(avg(-log2(greatest(coalesce(p, 1e-9), 1e-12))), 0.0) AS novelty FROM o_{m} LEFT JOIN share USING (itemid)" for m in LISTS},
    **{
        f"div_{m}": f"""SELECT coalesce(avg(coalesce(d, 0.0)), 0.0) AS diversity FROM (SELECT DISTINCT visitorid FROM o_{m}) LEFT JOIN (SELECT a.visitorid, 1 - avg(coalesce(sim, 0.0)) AS d
        FROM o_{m} a JOIN o_{m} b ON a.visitorid = b.visitorid AND a.itemid < b.itemid JOIN sets x ON x.itemid = a.itemid JOIN sets y ON y.itemid = b.itemid LEFT JOIN setsim ON pa = x.p AND pb = y.p GROUP BY a.visitorid) USING (visitorid)"""
        for m in LISTS
    },
    **{f"reach_{m}": f"SELECT count(DISTINCT visitorid) / CAST((SELECT count(*) FROM allusers) AS DOUBLE) AS user_reach FROM l_{m}" for m in LISTS},
    "results": " UNION ALL ".join(f"SELECT '{m}' AS model, \"precision\", recall, map, mrr, ndcg, catalog_coverage, novelty, diversity, user_reach, n_users_evaluated FROM k_{m}, cov_{m}, nov_{m}, div_{m}, reach_{m}" for m in LISTS),
}
CTES = BASE | shop("allev", "_a") | shop("trainev", "_t") | EVAL
NAME = re.compile(r"(?:\bFROM|\bJOIN|,)\s+(\w+)")


def build(select: str) -> str:
    """The select with the common table expressions that it needs, in an order in which each is known."""
    out: list[str] = []

    def need(sql: str) -> None:
        for name in dict.fromkeys(NAME.findall(sql)):
            if name in CTES and name not in out:
                need(CTES[name])
                out.append(name)

    need(select)
    # shared ones are computed once
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in out) + "\n" + select if out else select


def r(*names: str) -> str:
    return ", ".join(f'round({n}, 6) AS "{n}"' for n in names)


def listing(name: str, *cols: str, score: str = "score") -> str:
    return f"SELECT {', '.join(cols)}, {r(score)}, CAST(rank AS BIGINT) AS rank FROM {name}"


def _pairs_explained(select: str) -> str:
    near = NEAR.format(only="sets", n=3)
    return f"""SELECT item_a, item_b, {select} FROM (
        SELECT itemid AS item_a, similar_item AS item_b, a.price AS pa, b.price AS pb, a.categoryid = b.categoryid AS same, a.categoryid // 100 = b.categoryid // 100 AS kin
        FROM ({near}) n JOIN attrs a USING (itemid) JOIN attrs b ON b.itemid = n.similar_item)"""


JACCARD = "CASE WHEN same THEN 1.0 WHEN kin THEN 1 / 3.0 ELSE 0.0 END"
WHY = "'Recommended because it has ' || CASE WHEN same THEN 'same category' WHEN kin THEN 'related category' ELSE 'similar attributes' END || CASE WHEN least(pa, pb) / greatest(pa, pb) > 0.7 AND pa IS NOT NULL AND pb IS NOT NULL THEN ' and similar price range' ELSE '' END || ' to an item you viewed.'"
HIST = "SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((x - lo) * {bins} / (hi - lo)) + 1, {bins}) END AS BIGINT) AS bin, count(*) AS n FROM (SELECT {x} AS x FROM {of}), (SELECT min({x}) AS lo, max({x}) AS hi FROM {of}) GROUP BY 1"
HEAD = "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max(k) AS BIGINT) AS n_head, round(sum(CASE WHEN i <= k THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS head_share FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, {k} AS k FROM (SELECT count(*) AS n, count(*) OVER () AS rows FROM allev GROUP BY {by}))"
USER_DOUBLES = ("activity_score_raw", "avg_session_duration_sec", "median_session_duration_sec", "recency_days", "conversion_rate_user", "click_to_purchase_ratio_user", "user_activity_score")
ITEM_DOUBLES = ("price", "interaction_score_raw", "recency_days", "product_conversion_rate", "click_to_purchase_ratio_item", "product_interaction_score", "category_popularity_score")
FUNNEL_COUNTS = "count(*) FILTER (WHERE event = 'view') AS n_{v}, count(*) FILTER (WHERE event = 'addtocart') AS n_addtocart, count(*) FILTER (WHERE event = 'transaction') AS n_{t}"

SELECTS = {
    "trending_topk": f"SELECT itemid, categoryid, {r('product_interaction_score')} FROM items_a ORDER BY round(product_interaction_score, 9) DESC, itemid LIMIT 10",
    "trending_by_category": f"SELECT itemid, categoryid, {r('product_interaction_score')} FROM items_a WHERE categoryid = 101 ORDER BY round(product_interaction_score, 9) DESC, itemid LIMIT 10",
    "trending_excluding": f"SELECT itemid, categoryid, {r('product_interaction_score')} FROM items_a WHERE itemid NOT IN (SELECT itemid FROM allev WHERE visitorid = 1) ORDER BY round(product_interaction_score, 9) DESC, itemid LIMIT 10",
    "best_sellers_topk": "SELECT itemid, categoryid, item_transaction_count FROM items_a ORDER BY item_transaction_count DESC, itemid LIMIT 10",
    "recently_popular_7d": "SELECT itemid, categoryid, n AS recent_interactions FROM (SELECT itemid, count(*) AS n FROM allev WHERE us >= (SELECT max(us) FROM allev) - 7 * 86400000000 GROUP BY itemid) LEFT JOIN attrs USING (itemid) ORDER BY n DESC, itemid LIMIT 10",
    "product_search": f"SELECT itemid, categoryid, {r('price')}, item_view_count FROM items_a WHERE available = 1 AND (price IS NULL OR price BETWEEN 910 AND 1400) ORDER BY item_view_count DESC, itemid LIMIT 100",
    "product_search_category": f"SELECT itemid, {r('price')}, item_view_count FROM items_a WHERE categoryid = 101 ORDER BY item_view_count DESC, itemid LIMIT 100",
    "point_lookup": f"SELECT itemid, categoryid, item_view_count, {r('product_interaction_score')} FROM items_a WHERE itemid = 5",
    "clean_events_dedup": "SELECT visitorid, event, itemid, transactionid, us AS datetime FROM allev",
    "txn_invariant": "SELECT count(*) AS n_events, count(*) FILTER (WHERE (transactionid IS NULL) <> (event <> 'transaction')) AS n_broken, bool_and((transactionid IS NULL) = (event <> 'transaction')) AS holds FROM allev",
    "id_encoding": "SELECT visitorid, row_number() OVER (ORDER BY visitorid) - 1 AS user_idx FROM allusers",
    "item_id_encoding": "SELECT itemid, row_number() OVER (ORDER BY itemid) - 1 AS item_idx FROM known",
    "sessions_assign": "SELECT visitorid, us AS datetime, session_seq, visitorid || '_' || session_seq AS session_id FROM sess_a",
    "sessions_summary": "SELECT * REPLACE (round(duration_sec, 6) AS duration_sec) FROM sessum_a",
    "item_attributes_latest": f"SELECT itemid, categoryid, CAST(available AS BIGINT) AS available, has_category, {r('price')}, has_price FROM attrs",
    "category_tree_roots": "SELECT * FROM tree",
    "category_ancestors": "SELECT * FROM anc",
    "user_features": f"SELECT visitorid, user_view_count, user_addtocart_count, user_purchase_count, unique_items_viewed, unique_categories_viewed, first_seen, last_seen, n_sessions, {r(*USER_DOUBLES)} FROM users_a",
    "category_features": f"SELECT categoryid, category_view_count, category_addtocart_count, category_transaction_count, total_interactions, num_items_in_category, {r('category_popularity_score')} FROM cats_a",
    "item_features": f"SELECT itemid, categoryid, CAST(available AS BIGINT) AS available, has_category, has_price, item_view_count, item_addtocart_count, item_transaction_count, unique_visitors, last_seen, is_cold_start, popularity_rank, {r(*ITEM_DOUBLES)} FROM items_a",
    "popularity_rank": "SELECT itemid, item_view_count, popularity_rank FROM items_a",
    "dashboard_kpis": f"SELECT *, round(coalesce(n_transactions / nullif(CAST(n_views AS DOUBLE), 0), 0), 6) AS conversion_rate, round(100 - 100 * coalesce(n_transactions / nullif(CAST(n_addtocart AS DOUBLE), 0), 0), 6) AS cart_abandonment_pct FROM (SELECT count(*) AS n_events, {FUNNEL_COUNTS.format(v='views', t='transactions')}, count(DISTINCT visitorid) AS n_visitors, count(DISTINCT itemid) AS n_items FROM allev)",
    "event_funnel": "SELECT event, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM allev), 6) AS pct FROM allev GROUP BY event",
    "top_categories": f"SELECT categoryid, category_view_count, category_addtocart_count, category_transaction_count, total_interactions, num_items_in_category, {r('category_popularity_score')} FROM cats_a ORDER BY total_interactions DESC, categoryid LIMIT 10",
    "heatmap_dow_hour": "SELECT day, hour, count(datetime) AS n FROM (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS day), (SELECT DISTINCT hour(datetime) AS hour FROM allev) LEFT JOIN allev ON strftime(datetime, '%A') = day AND hour(datetime) = hour GROUP BY day, hour",
    "events_by_dow": "SELECT strftime(datetime, '%A') AS day, count(*) AS n FROM allev GROUP BY 1",
    "events_by_hour": f"SELECT hour(datetime) AS hour, count(*) AS n, {FUNNEL_COUNTS.format(v='view', t='transaction')} FROM allev GROUP BY 1",
    "daily_volume": "SELECT strftime(d, '%Y-%m-%d') AS day, count(datetime) AS n FROM (SELECT unnest(generate_series((SELECT min(datetime)::DATE FROM allev), (SELECT max(datetime)::DATE FROM allev), INTERVAL 1 DAY)) AS d) LEFT JOIN allev ON datetime::DATE = d::DATE GROUP BY 1",
    "quality_counters": """SELECT rows_raw, rows_clean, rows_raw - rows_clean AS rows_dropped, n_sessions, events_per_session, no_category, no_price, unavailable, root_categories, child_categories, cold_items, cold_share
        FROM (SELECT count(*) + count(*) FILTER (WHERE event_id % 100 = 0) AS rows_raw, count(*) AS rows_clean FROM allev), (SELECT count(*) AS n_sessions, round(avg(n_events), 6) AS events_per_session FROM sessum_a),
        (SELECT count(*) FILTER (WHERE NOT has_category) AS no_category, count(*) FILTER (WHERE NOT has_price) AS no_price, count(*) FILTER (WHERE available = 0) AS unavailable FROM attrs),
        (SELECT count(*) FILTER (WHERE is_root) AS root_categories, count(*) FILTER (WHERE NOT is_root) AS child_categories FROM tree), (SELECT count(*) FILTER (WHERE is_cold_start) AS cold_items, round(avg(CAST(is_cold_start AS INT)), 6) AS cold_share FROM items_a)""",
    "category_values": "SELECT DISTINCT categoryid FROM attrs WHERE categoryid IS NOT NULL",
    "column_bounds": "SELECT round(min(price), 6) AS min_price, round(max(price), 6) AS max_price, min(itemid) AS min_item, max(itemid) AS max_item FROM attrs",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100.0 * avg(CAST({c} IS NULL AS INT)), 6) AS null_pct FROM allev" for c in ("visitorid", "event", "itemid", "transactionid", "datetime")),
    "activity_concentration": HEAD.format(by="visitorid", k="CAST(floor(rows * 0.05) AS BIGINT)"),
    "item_power_law": HEAD.format(by="itemid", k="greatest(CAST(floor(rows * 0.01) AS BIGINT), 1)"),
    "conversion_min_views": "SELECT itemid, views, carts, purchases, round(purchases / CAST(views AS DOUBLE), 6) AS view_to_purchase, round(purchases / nullif(CAST(carts AS DOUBLE), 0), 6) AS cart_to_purchase FROM (SELECT itemid, count(*) FILTER (WHERE event = 'view') AS views, count(*) FILTER (WHERE event = 'addtocart') AS carts, count(*) FILTER (WHERE event = 'transaction') AS purchases FROM allev GROUP BY itemid) WHERE views >= 20 ORDER BY round(purchases / CAST(views AS DOUBLE), 9) DESC, itemid LIMIT 10",
    "repeat_visitors": "SELECT count(*) AS n_visitors, round(avg(CAST(days > 1 AS INT)), 6) AS repeat_share, round(avg(CAST(n = 1 AS INT)), 6) AS single_event_share, round(avg(n), 6) AS mean_events, round(quantile_cont(n, 0.5), 6) AS median_events FROM (SELECT count(DISTINCT datetime::DATE) AS days, count(*) AS n FROM allev GROUP BY visitorid)",
    "category_breadth": "SELECT round(avg(c), 6) AS mean_categories, round(quantile_cont(c, 0.5), 6) AS median_categories, round(avg(CAST(c > 1 AS INT)), 6) AS several_share FROM (SELECT count(DISTINCT categoryid) AS c FROM allev LEFT JOIN attrs USING (itemid) GROUP BY visitorid)",
    "outlier_p99": "SELECT round(cap, 6) AS cap, count(*) FILTER (WHERE n > cap) AS n_above, max(n) AS most FROM (SELECT count(*) AS n FROM allev GROUP BY visitorid), (SELECT quantile_cont(n, 0.99) AS cap FROM (SELECT count(*) AS n FROM allev GROUP BY visitorid)) GROUP BY cap",
    "view_histogram": HIST.format(bins=20, x="CAST(item_view_count AS DOUBLE)", of="items_a"),
    "score_histogram": HIST.format(bins=30, x="least(user_activity_score, 0.9)", of="users_a"),
    "zero_view_items": "SELECT count(*) AS n_zero_view FROM attrs WHERE itemid NOT IN (SELECT itemid FROM allev WHERE event = 'view')",
    "trending_bestseller_overlap": "SELECT count(*) AS n_shared, round(count(*) / CAST((SELECT least(50, count(*)) FROM items_a) AS DOUBLE), 6) AS share FROM (SELECT itemid FROM items_a ORDER BY round(product_interaction_score, 9) DESC, itemid LIMIT 50) JOIN (SELECT itemid FROM items_a ORDER BY item_transaction_count DESC, itemid LIMIT 50) USING (itemid)",
    "demo_visitors": "SELECT * FROM (SELECT visitorid, 'active' AS kind FROM users_a ORDER BY round(user_activity_score, 9) DESC, visitorid LIMIT 5) UNION ALL SELECT * FROM (SELECT visitorid, 'casual' FROM users_a WHERE user_activity_score > 0.05 AND user_activity_score < 0.25 ORDER BY md5('42:' || visitorid) LIMIT 5) UNION ALL SELECT CAST(999999999 AS BIGINT), 'cold'",
    "known_items": "SELECT itemid, itemid IN (SELECT itemid FROM m_a) AS has_history FROM items_a",
    "csv_round_trip": "SELECT us // 1000 AS timestamp, visitorid, event, itemid, transactionid FROM allev",
    "avg_tie_rank": "SELECT itemid, item_view_count, rank() OVER (ORDER BY item_view_count DESC) + (count(*) OVER (PARTITION BY item_view_count) - 1) / 2.0 AS avg_rank FROM items_a",
    "recently_viewed": "SELECT visitorid, row_number() OVER (PARTITION BY visitorid ORDER BY max(us) DESC, itemid) AS rank, itemid FROM allev GROUP BY visitorid, itemid QUALIFY rank <= 10",
    "sorted_items": "SELECT itemid, unique_visitors AS value FROM items_a ORDER BY unique_visitors DESC, itemid LIMIT 15",
    "matrix_sparsity": "SELECT count(DISTINCT visitorid) AS n_users, count(DISTINCT itemid) AS n_items, count(*) AS n_pairs, round(1 - count(*) / CAST(count(DISTINCT visitorid) * count(DISTINCT itemid) AS DOUBLE), 6) AS sparsity FROM m_a",
    "item_labels": "SELECT itemid, 'Item ' || itemid || ' (category ' || categoryid || ')' AS label, CASE WHEN price IS NOT NULL THEN format('${:,.2f}', price) ELSE 'Price not available' END AS price_text FROM attrs",
    "confidence_scatter": f"SELECT visitorid, user_view_count + user_addtocart_count + user_purchase_count AS total_interactions, {r('user_activity_score')} FROM users_a",
    "events_span": "SELECT min(us) AS first_us, max(us) AS last_us, strftime(min(datetime), '%Y-%m-%d') AS first_day, strftime(max(datetime), '%Y-%m-%d') AS last_day FROM allev",
    "fbt_pairs": f"SELECT item_a, item_b, n_pair, n_item, {r('confidence')} FROM fbt",
    "fbt_topk": f"SELECT item_a, item_b, n_pair, n_item, {r('confidence')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY n_pair DESC, item_b) AS rank FROM fbt) WHERE rank <= 5",
    "fbt_coverage": "SELECT *, round(n_paired / CAST(n_items AS DOUBLE), 6) AS coverage FROM (SELECT count(DISTINCT itemid) FILTER (WHERE itemid IN (SELECT item_a FROM fbt)) AS n_paired, count(DISTINCT itemid) AS n_items FROM basket)",
    "price_buckets": f"SELECT itemid, {r('price')}, price_bucket FROM bucketed",
    "tfidf_vectors": f"SELECT itemid, token, {r('w')} FROM tfidf",
    "content_similar_items": "SELECT itemid, similar_item, round(content_similarity, 6) AS content_similarity, rank FROM (" + NEAR.format(only="sets", n=5) + ")",
    "content_profile_recs": listing("con_a", "visitorid", "itemid"),
    "category_jaccard": _pairs_explained(f"round({JACCARD}, 6) AS category_similarity"),
    "content_profile_excluding": f"SELECT visitorid, itemid, {r('score')}, CAST(rank AS BIGINT) AS rank FROM ({content('ask_a', '(SELECT visitorid, itemid FROM allev UNION SELECT visitorid, itemid + 1 FROM allev)', '_a')})",
    "content_explain": _pairs_explained(f"round({JACCARD}, 6) AS category_similarity, {WHY} AS explanation"),
    "content_top1_similarity": "SELECT round(content_similarity, 6) AS similarity, count(*) AS n FROM (" + NEAR.format(only="sets", n=1) + ") GROUP BY 1",
    "interaction_matrix": f"SELECT visitorid, itemid, {r('weight')} FROM m_a",
    "cf_exclusions": f"SELECT 'user' AS kind, visitorid AS id, {r('total')} FROM xu_a UNION ALL SELECT 'item', itemid, {r('total')} FROM xi_a",
    "cf_exclusions_high": f"SELECT 'user' AS kind, visitorid AS id, {r('total')} FROM (SELECT visitorid, sum(weight) AS total FROM m_a GROUP BY visitorid HAVING sum(weight) < 40) UNION ALL SELECT 'item', itemid, {r('total')} FROM (SELECT itemid, sum(weight) AS total FROM m_a GROUP BY itemid HAVING sum(weight) < 150)",
    "cf_item_similar": "SELECT a AS item, b AS similar_item, rank, round(sim, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM si_a WHERE a <> b AND a NOT IN (SELECT itemid FROM xi_a)) WHERE rank <= 10",
    "cf_item_recs": listing("cfi_a", "visitorid", "itemid"),
    "cf_user_recs": listing("cfu_a", "visitorid", "itemid"),
    "cf_confidence": f"SELECT visitorid, {r('cf_confidence')} FROM conf_a",
    "hybrid_recs": f"SELECT visitorid, itemid, {r('hybrid_score', 'cf_confidence_used')}, rank FROM hyb_a",
    "hybrid_seeded": f"SELECT visitorid, itemid, {r('hybrid_score', 'cf_confidence_used')}, rank FROM ({hybrid('ask_a', '_a', '5')})",
    "hybrid_user_based": f"SELECT visitorid, itemid, {r('hybrid_score', 'cf_confidence_used')}, rank FROM ({hybrid('ask_a', '_a', cf=cf_users(30, '_a'))})",
    "hybrid_explain_seeded": f"""SELECT visitorid, itemid, {WHY} AS explanation FROM (
        SELECT h.visitorid, h.itemid, a.price AS pa, b.price AS pb, a.categoryid = b.categoryid AS same, a.categoryid // 100 = b.categoryid // 100 AS kin
        FROM ({hybrid('ask_a', '_a', '5')}) h JOIN attrs a ON a.itemid = 5 JOIN attrs b ON b.itemid = h.itemid)""",
    "hybrid_explain": "SELECT visitorid, itemid, CASE WHEN cf_confidence_used > 0.3 THEN 'Recommended based on your browsing and purchase history.' ELSE 'Recommended because it''s popular among shoppers with similar interests.' END AS explanation FROM hyb_a",
    "temporal_split": "SELECT 'train' AS part, count(*) AS n, max(us) AS last FROM trainev UNION ALL SELECT 'test', count(*), max(us) FROM testev",
    "eval_targets": "SELECT * FROM targets",
    **{f"ranking_metrics_{m}": f"SELECT {r('precision', 'recall', 'map', 'mrr', 'ndcg')}, n_users_evaluated FROM k_{m}".replace("round(precision,", 'round("precision",') for m in LISTS},
    "catalog_coverage": f"SELECT {r('catalog_coverage')} FROM cov_cf_item",
    "novelty": f"SELECT {r('novelty')} FROM nov_cf_item",
    "diversity": f"SELECT {r('diversity')} FROM div_cf_item",
    "user_reach": f"SELECT {r('user_reach')} FROM reach_cf_item",
    "buyer_confidence": "SELECT count(*) AS n, round(quantile_cont(user_activity_score, 0.5), 6) AS median_score, round(avg(user_activity_score), 6) AS mean_score FROM (SELECT DISTINCT visitorid FROM targets) JOIN users_t USING (visitorid)",
    "model_comparison": f"SELECT model, {r('precision', 'recall', 'map', 'mrr', 'ndcg', 'catalog_coverage', 'novelty', 'diversity', 'user_reach')}, n_users_evaluated, round(CASE WHEN b > 0 THEN (ndcg - b) / b * 100 ELSE CAST('inf' AS DOUBLE) END, 6) AS lift_percent FROM results, (SELECT ndcg AS b FROM results WHERE model = 'popularity')".replace("round(precision,", 'round("precision",'),
}
_BEST = 'SELECT * FROM results ORDER BY round(ndcg, 9) DESC, model LIMIT 1'
SELECTS["narrative"] = f"""SELECT printf('Highest raw accuracy: ''%s'', NDCG@10=%.4f (%+.0f%% against popularity), precision %.4f, recall %.4f, reach %.1f%%.', b.model, b.ndcg, (b.ndcg - p.ndcg) / p.ndcg * 100, b."precision", b.recall, b.user_reach * 100)
    || CASE WHEN b.model <> 'hybrid' THEN printf(' Hybrid shows %.1f%% of the catalog against %.1f%%, reaches %.1f%% of users and keeps %.0f%% of that accuracy.', h.catalog_coverage * 100, b.catalog_coverage * 100, h.user_reach * 100, coalesce(h.ndcg / nullif(b.ndcg, 0), 0.0) * 100) ELSE '' END AS explanation
    FROM ({_BEST}) b, (SELECT * FROM results WHERE model = 'hybrid') h, (SELECT * FROM results WHERE model = 'popularity') p"""
ORACLE_SQL = {name: build(sql) for name, sql in SELECTS.items()}
