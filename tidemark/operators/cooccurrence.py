"""Co-occurrence: baskets, the interaction matrix in coordinates, item and user neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CF_EXTRA, CF_NEIGHBOURS, MIN_INTERACTIONS, TOP_K
from ..functions.scoring import by_score, event_weight, top_per
from ..sources.files import materialized


def baskets(purchases: DataFrame) -> DataFrame:
    """transactionid, itemid: distinct items of each transaction."""
    # plain conditions, which a plan has once: all that reads baskets then has the same filters, and reads the same shuffle
    return purchases.where("event = 'transaction' AND transactionid IS NOT NULL AND itemid IS NOT NULL").select("transactionid", "itemid").distinct()


def basket_pairs(basket: DataFrame, block: int, ordered: bool = True) -> DataFrame:
    """item_a, item_b: ordered pairs of different items of a basket; or, not ``ordered``, each two items once, the smaller first. Of a basket of more than ``block`` items, pairs of blocks are dealt out, so
    that a task makes some ``block`` times ``block`` pairs at a time, however large the basket is."""
    sized = basket.withColumn("m", F.count("*").over(W.partitionBy("transactionid")))
    few = sized.where((F.col("m") > 1) & (F.col("m") <= block)).select("transactionid", F.col("itemid").alias("item_a"))
    pairs = few.join(basket.select("transactionid", F.col("itemid").alias("item_b")), "transactionid").where("item_a < item_b").select("item_a", "item_b")
    # items of large baskets are spread over tasks before they are repeated
    many = sized.where(F.col("m") > block).repartition("transactionid", "itemid").withColumn("blocks", F.ceil(F.col("m") / F.lit(float(block))).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("itemid"), F.col("blocks")).cast("int"))
    left = many.select("transactionid", F.col("itemid").alias("x"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"))
    right = many.select("transactionid", F.col("itemid").alias("y"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    blocks = left.join(right, ["transactionid", "i", "j"]).where("i < j OR x < y")
    once = pairs.union(blocks.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")))
    return both_ways(once) if ordered else once


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each row with item_a and item_b, and with the two exchanged."""
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("item_a"), F.col(y).alias("item_b")) for x, y in (("item_a", "item_b"), ("item_b", "item_a"))])).alias("way")
    more = [c for c in pairs.columns if c not in ("item_a", "item_b")]
    return pairs.select(ways, *more).select("way.item_a", "way.item_b", *more)


def pair_counts(basket: DataFrame, block: int = 1000) -> DataFrame:
    """item_a, item_b, n_pair, n_item, confidence for ordered pairs of items bought together. Both orders of two items have one count: it is made once and then read both ways."""
    pairs = both_ways(basket_pairs(basket, block, ordered=False).groupBy("item_a", "item_b").agg(F.count("*").alias("n_pair")))
    items = basket.groupBy(F.col("itemid").alias("item_a")).agg(F.count("*").alias("n_item"))
    return pairs.join(items, "item_a").withColumn("confidence", F.col("n_pair") / F.col("n_item"))


def bought_together(pairs: DataFrame, n: int = TOP_K, min_support: int = 1) -> DataFrame:
    """The most frequent partners of every item."""
    return top_per(pairs.where(F.col("n_pair") >= min_support), ["item_a"], [F.desc("n_pair"), F.asc("item_b")], n)


def basket_coverage(basket: DataFrame) -> DataFrame:
    """One row: share of the items in any basket that have a partner. An item has one if a basket of its has two items or more."""
    sizes = basket.groupBy("transactionid").agg(F.count("*").alias("size"))
    by_item = basket.join(sizes, "transactionid").groupBy("itemid").agg((F.max("size") > 1).alias("paired"))
    return by_item.agg(F.count_if("paired").alias("n_paired"), F.count("*").alias("n_items")).withColumn("coverage", F.coalesce(F.try_divide(F.col("n_paired").cast("double"), F.col("n_items").cast("double")), F.lit(0.0)))


def interactions(events: DataFrame) -> DataFrame:
    """visitorid, itemid, weight: the matrix in coordinates; pairs whose events weigh nothing stay, with 0."""
    return events.groupBy("visitorid", "itemid").agg(F.sum(event_weight(F.col("event"))).alias("weight"))


def excluded(matrix: DataFrame, key: str, least: float = MIN_INTERACTIONS) -> DataFrame:
    """Users or items whose weights add up to less than ``least``: too little to go by."""
    return matrix.groupBy(key).agg(F.sum("weight").alias("total")).where(F.col("total") < least)


def unit_rows(matrix: DataFrame, key: str, over: str) -> DataFrame:
    """k, o, w: rows of ``key`` of length 1 in coordinates, without zeros."""
    norms = matrix.where("weight > 0").groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return matrix.where("weight > 0").join(norms, key).select(F.col(key).alias("k"), F.col(over).alias("o"), (F.col("weight") / F.col("norm")).alias("w"))


#: Rows that share an ``over`` are compared with each other up to so many; beyond it only where they may matter, and in blocks of that size.
LIGHT = 1000
#: An index of so many rows at most is sent to all tasks; so many rows that ask are a task's then.
SMALL, ASKING = 100_000, 1 << 14
#: Of bounds on similarities: lists order them to nine digits.
SLACK = 2e-9


def heavy_products(heavy: DataFrame, keys: DataFrame, block: int, asking: DataFrame | None = None) -> DataFrame:
    """a, b, sim: products over the columns of ``heavy`` (k, o, w, m: rows that ask in o) of pairs whose bound reaches a's threshold. ``keys``: k, h (length of the
    heavy part) and, unless others ask, t (threshold, above 0). ``asking`` (a, o, wa, ha, t, m): rows of another table that ask.

    A product is at most h of a times h of b. Rows of a column are dealt into levels of h, each level into blocks, and a row of a meets levels
    only that may bring enough. The other side is dealt into blocks too, so a pair of blocks has about ``block`` times ``block`` pairs, however
    many rows a column has."""
    level = F.floor(-2 * F.log2(F.greatest(F.col("h"), F.lit(1e-30)))).cast("int")
    rows = heavy.join(keys, "k").withColumn("level", level)
    cells = rows.groupBy("o", "level").agg(F.count("*").alias("n"), F.max("h").alias("most"))
    cells = cells.select("o", "level", "most", F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias("blocks"))
    lefts = F.ceil(F.col("m") / F.lit(float(block))).cast("int")
    left = rows.where("t IS NOT NULL").select("o", F.col("k").alias("a"), F.col("w").alias("wa"), F.col("h").alias("ha"), "t", "m") if asking is None else asking
    left = left.withColumn("part", F.pmod(F.xxhash64("a"), lefts).cast("int"))
    left = left.join(cells, "o").where("ha * most >= t").withColumn("block", each_of(F.col("blocks"))).select("o", "level", "block", "part", "a", "wa", "ha", "t")
    right = rows.join(cells.drop("most"), ["o", "level"]).withColumn("part", each_of(lefts))
    right = right.select("o", "level", F.pmod(F.xxhash64(F.col("k"), F.lit(1)), F.col("blocks")).cast("int").alias("block"), "part", F.col("k").alias("b"), F.col("w").alias("wb"), F.col("h").alias("hb"))
    pairs = left.join(right, ["o", "level", "block", "part"]).where("ha * hb >= t" if asking is not None else "a <> b AND ha * hb >= t")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def each_of(n: Column) -> Column:
    """A row for each of 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def nearest_rows(index: DataFrame, n: int | None = None, light: int = LIGHT, asking: DataFrame | None = None, skip: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """a, b, sim > 0: for each row that asks the rows of ``index`` (k, o, w; of length 1 at most) of greatest product, equal ones (to nine digits) by b.
    ``asking`` (k, o, w, n) asks for n each; without it the index's own rows (of ``only``, and not of ``skip``: k) ask for ``n`` others.

    Exact, without making all pairs that share a column. Columns of at most ``light`` rows of the index are joined; what two rows have in common
    there is part of their product, so the n-th best of it is a threshold for the row that asks. What heavy columns may add is at most the product
    of the lengths of the rows' heavy parts: pairs below the threshold even so are dropped; of the rest those with a light column in common look
    up their heavy products, and others are found by levels of length (``heavy_products``). Rows that ask in a light column are dealt into
    blocks of ``light`` too, so no task makes more than ``light`` times ``light`` pairs of a column at a time."""
    own = asking is None
    rows = index.join(index.groupBy("o").agg(F.count("*").alias("n_rows")), "o")
    if own:
        rows = left = materialized(rows.withColumn("m", F.col("n_rows")), "unit")
        left = left if skip is None else left.join(skip, "k", "left_anti")
        left = (left if only is None else left.join(only, "k", "left_semi")).withColumn("n", F.lit(n))
    else:
        asking = materialized(asking, "asking")
        rows = materialized(rows.join(asking.groupBy("o").agg(F.count("*").alias("m")), "o"), "unit")
        left = asking.join(rows.groupBy("o").agg(F.max("n_rows").alias("n_rows"), F.max("m").alias("m")), "o")
    lengths = left.groupBy("k").agg(F.max("n").alias("n")).withColumnRenamed("k", "a")

    def listed(pairs: DataFrame) -> DataFrame:
        return top_per(pairs if own or "n" in pairs.columns else pairs.join(lengths, "a"), ["a"], by_score("sim", "b"), F.lit(n) if own else F.col("n"), "near")

    parts = F.ceil(F.col("m") / F.lit(float(light))).cast("int")
    few, heavy = F.col("n_rows") <= light, F.col("n_rows") > light
    product = F.sum(F.col("wa") * F.col("wb")).alias("sim")
    if not own and rows.count() <= SMALL:
        # each task has all of a small index: pairs are added up and ranked where the row that asks is, and none goes through a shuffle
        lights = left.where(few).select("o", F.col("k").alias("a"), F.col("w").alias("wa"), "n").repartition(-(-asking.count() // ASKING) or 1, "a")
        shared = lights.join(F.broadcast(rows.where(few).select("o", F.col("k").alias("b"), F.col("w").alias("wb"))), "o").groupBy("a", "b").agg(product, F.max("n").alias("n"))
    else:
        lights = left.where(few).select("o", F.pmod(F.xxhash64("k"), parts).cast("int").alias("part"), F.col("k").alias("a"), F.col("w").alias("wa"))
        shared = lights.join(rows.where(few).select("o", each_of(parts).alias("part"), F.col("k").alias("b"), F.col("w").alias("wb")), ["o", "part"])
        shared = (shared.where("a <> b") if own else shared).groupBy("a", "b").agg(product)
    if rows.where(heavy).isEmpty():
        return listed(shared).select("a", "b", "sim")
    shared = materialized(shared, "shared")
    length = F.sqrt(F.sum(F.when(heavy, F.col("w") * F.col("w")).otherwise(0.0)))
    least = listed(shared).where(F.col("near") == (F.lit(n) if own else F.col("n"))).select(F.col("a").alias("k"), (F.col("sim") - SLACK).alias("t"))
    ends = left.groupBy("k").agg(length.alias("ha")).join(least, "k", "left")
    ends = materialized(ends.select(F.col("k").alias("a"), "ha", F.greatest(F.coalesce("t", F.lit(1e-300)), F.lit(1e-300)).alias("t")), "ends")
    keys = materialized(rows.groupBy("k").agg(length.alias("h")), "keys")
    kept = shared.join(ends, "a").join(keys.withColumnsRenamed({"k": "b", "h": "hb"}), "b").where("sim + ha * hb >= t").select("a", "b", "sim", F.expr("ha * hb < t").alias("asks"))
    wide, wide_left = rows.where(heavy).select("k", "o", "w", "m"), left.where(heavy).select(F.col("k").alias("a"), "o", F.col("w").alias("wa"), "m")
    asked = kept.where("asks").select("a", "b").join(wide_left.drop("m"), "a").join(wide.drop("m").withColumnsRenamed({"k": "b", "w": "wb"}), ["b", "o"])
    found = heavy_products(wide, keys, light, wide_left.join(ends, "a"))
    sums = kept.select("a", "b", "sim").union(asked.select("a", "b", (F.col("wa") * F.col("wb")).alias("sim"))).union(found.where("a <> b") if own else found)
    return listed(sums.groupBy("a", "b").agg(F.sum("sim").alias("sim"))).select("a", "b", "sim")


def nearest(matrix: DataFrame, key: str, over: str, n: int, skip: DataFrame | None = None, light: int = LIGHT) -> DataFrame:
    """a, b, sim > 0: for each ``key`` but those of ``skip`` (k) the ``n`` others of greatest cosine, equal ones (to nine digits) by b."""
    return nearest_rows(unit_rows(matrix, key, over), n, light, skip=skip)


def similar_items(matrix: DataFrame, n: int = TOP_K) -> DataFrame:
    """item, similar_item, rank, score for every item with enough interactions; an item is none of its own neighbours."""
    sims = nearest(matrix, "itemid", "visitorid", n, excluded(matrix, "itemid").select(F.col("itemid").alias("k")))
    return top_per(sims, ["a"], by_score("sim", "b"), n).select(F.col("a").alias("item"), F.col("b").alias("similar_item"), "rank", F.col("sim").alias("score"))


def alike(rows: DataFrame, key: str = "visitorid") -> tuple[DataFrame, DataFrame]:
    """``key``, head: the smallest key of the same rows in all other columns; and the rows of heads, with size: how many keys have the same."""
    others = [c for c in rows.columns if c != key]
    packed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("row"))
    packed = materialized(packed.withColumn("digest", F.xxhash64("row")), "rows")  # tells nearly all rows apart, so that sorts seldom compare rows themselves
    distinct = materialized(packed.groupBy("digest", "row").agg(F.min(key).alias("head"), F.count("*").alias("size")), "distinct")
    heads = materialized(packed.join(distinct.select("digest", "row", "head"), ["digest", "row"]).select(key, "head"), "heads")
    return heads, materialized(distinct.select(F.col("head").alias(key), "size", F.explode("row").alias("c")).select(key, "size", *[F.col(f"c.{c}").alias(c) for c in others]), "distinct_rows")


def recommend_by_items(matrix: DataFrame, n: int = TOP_K, users: DataFrame | None = None) -> DataFrame:
    """visitorid, itemid, score, rank. Each item a user touched brings its n + 5 nearest items, itself and seen ones counted, with
    similarity times weight. ``users`` (visitorid, n) gives each user an own n."""
    fixed = users is None
    who = (matrix.select("visitorid").distinct().withColumn("n", F.lit(n)) if fixed else users).join(excluded(matrix, "visitorid"), "visitorid", "left_anti")
    who = who if fixed else materialized(who.select("visitorid", "n"), "who")
    most = CF_EXTRA + (n if fixed else who.agg(F.max("n")).first()[0] or 0)
    # visitors of equal rows and lengths are answered once; to the items they are a column of root of their number times the length
    heads, cells = alike(matrix.select("visitorid", "itemid", "weight").join(who.select("visitorid", "n"), "visitorid", "left"))
    near = nearest(cells.select("visitorid", "itemid", (F.col("weight") * F.sqrt("size")).alias("weight")), "itemid", "visitorid", most - 1)
    # an item is its own nearest, before any equal one
    near = top_per(near, ["a"], by_score("sim", "b"), most - 1, "near").withColumn("near", F.col("near") + 1)
    near = near.select("a", "b", "sim", "near").union(cells.where("weight > 0").select("itemid").distinct().select(F.col("itemid").alias("a"), F.col("itemid").alias("b"), F.lit(1.0), F.lit(1)))
    near = materialized(near, "near")
    seeds = cells.where("n IS NOT NULL").select("visitorid", "n", F.col("itemid").alias("a"), "weight")
    if near.count() <= SMALL:  # then scores are added up where a visitor's items are
        seeds, near = seeds.repartition(-(-cells.count() // ASKING) or 1, "visitorid"), F.broadcast(near)
    found = seeds.join(near, "a").where(F.col("near") <= F.col("n") + CF_EXTRA)
    # an item that a visitor has met brings itself, so what is seen needs no second look at the matrix
    scored = found.groupBy("visitorid", "n", F.col("b").alias("itemid")).agg(F.sum(F.col("weight") * F.col("sim")).alias("score"), F.max(F.col("a") == F.col("b")).alias("seen"))
    best = top_per(scored.where("NOT seen").drop("seen"), ["visitorid"], by_score("score", "itemid"), F.col("n"))
    return heads.join(best.withColumnRenamed("visitorid", "head"), "head").select("visitorid", "itemid", "score", "rank")


#: Rows and columns of a product of ``block_nearest``; coordinates of a block of rows; blocks that there are at least, where each has ``DENSE_ROWS`` rows even so.
DENSE_ROWS, DENSE_COLUMNS, DENSE_CELLS, DENSE_BLOCKS = 2048, 1024, 1 << 21, 8


def block_nearest(unit: DataFrame, n: int, asks: DataFrame, block: int = DENSE_ROWS, cells: int = DENSE_CELLS) -> DataFrame:
    """a, b, sim > 0 as by ``nearest_rows``, for rows that share so many columns that nearly all pairs have something in common. Each pair of blocks of rows
    is a task's, which multiplies ``block`` rows by as many at a time and keeps the ``n`` nearest of each row, so no pair becomes a row but those.

    Every row is sent to as many tasks as there are blocks. So a block has as many rows as make ``cells`` coordinates, not a number that is fixed: what is
    shuffled is the square of all coordinates by ``cells``."""
    rows = unit.where("o IS NOT NULL").groupBy("k").agg(F.collect_list("o").alias("os"), F.collect_list("w").alias("ws")).join(asks.select("k", F.lit(True).alias("asks")), "k", "left")
    rows = materialized(rows.withColumn("asks", F.coalesce("asks", F.lit(False))), "packed")
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("os")), F.lit(0)).alias("cells")).first()
    blocks = max(-(-size["cells"] // cells), min(-(-size["rows"] // block), DENSE_BLOCKS), 1)
    own, other = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"), each_of(F.lit(blocks))
    left, right = rows.where("asks").select("k", "os", "ws", own.alias("i"), other.alias("j")), rows.select(*[F.col(c).alias(c) for c in ("k", "os", "ws")], other.alias("i"), own.alias("j"))

    def run(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        out = []
        rights = rights.sort_by("k")  # equal ones by key
        for at in range(0, len(lefts), block):
            ka, *mine = cells_of(lefts.slice(at, block))
            best, least = np.empty((0, 3)), np.full(len(ka), 0.0)  # row, place in rights, product of the nearest so far; and the n-th of them, to nine digits
            for to in range(0, len(rights), block):
                kb, *theirs = cells_of(rights.slice(to, block))
                sims = products(mine, len(ka), theirs, len(kb))
                if n < len(kb) and not least.all():  # a row's own product is one of n + 1
                    least = np.maximum(least, np.partition(sims, -n - 1, axis=1)[:, -n - 1])
                row, col = np.nonzero((sims > 0) & (sims >= least[:, None] - SLACK))
                other_row = ka[row] != kb[col]
                row, col = row[other_row], col[other_row]
                best = np.concatenate([best, np.column_stack([row, col + to, sims[row, col]])])
                order = np.lexsort((best[:, 1], -np.round(best[:, 2], 9), best[:, 0]))
                best = best[order]
                start = np.searchsorted(best[:, 0], np.arange(len(ka)))
                best = best[np.arange(len(best)) - start[best[:, 0].astype(int)] < n]
                counts = np.bincount(best[:, 0].astype(int), minlength=len(ka))
                full = counts >= n
                least[full] = np.round(best[np.cumsum(counts)[full] - 1, 2], 9)
            out.append((ka[best[:, 0].astype(int)], rights.column("k").to_numpy()[best[:, 1].astype(int)], best[:, 2]))
        none = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
        return pa.table({name: np.concatenate([x[i] for x in [none, *out]]) for i, name in enumerate(("a", "b", "sim"))})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "a long, b long, sim double")
    return top_per(found, ["a"], by_score("sim", "b"), n, "near").select("a", "b", "sim")


def products(a: list[np.ndarray], n_a: int, b: list[np.ndarray], n_b: int) -> np.ndarray:
    """Of all rows of two sparse matrices, given by row, column and value of their cells."""
    out = np.zeros((n_a, n_b))
    columns = np.intersect1d(a[1], b[1])
    for at in range(0, len(columns), DENSE_COLUMNS):
        some = columns[at : at + DENSE_COLUMNS]
        out += dense(*a, n_a, some) @ dense(*b, n_b, some).T
    return out


def cells_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and of each cell its row, column and value."""
    os, ws = (rows.column(c).combine_chunks() for c in ("os", "ws"))
    return rows.column("k").to_numpy(), np.repeat(np.arange(len(rows)), os.value_lengths().to_numpy()), os.flatten().to_numpy(), ws.flatten().to_numpy()


def dense(row: np.ndarray, column: np.ndarray, value: np.ndarray, n_rows: int, columns: np.ndarray) -> np.ndarray:
    """The part of a matrix at some sorted ``columns``."""
    at = np.searchsorted(columns, column)
    here = columns[np.minimum(at, len(columns) - 1)] == column
    out = np.zeros((n_rows, len(columns)))
    out[row[here], at[here]] = value[here]
    return out


class UserNeighbours:
    """Nearest users, found between distinct rows of the matrix: users whose rows are equal in all weights are equally near to all others.

    ``heads``: visitorid, head (the smallest user of the same row). ``lists``: head, rank, b, b_head, sim: the ``n`` + 1 nearest users of a row, users of the row
    itself among them; a user's neighbours are those but itself, or but the last."""

    def __init__(self, matrix: DataFrame, n: int, light: int = LIGHT):
        self.n = n
        self.heads, cells = alike(matrix.select("visitorid", "itemid", "weight"))
        self.matrix = cells.drop("size")
        unit = materialized(unit_rows(self.matrix, "visitorid", "itemid"), "unit")
        few = excluded(self.matrix, "visitorid").select(F.col("visitorid").alias("k"))
        asks = unit.select("k").distinct().join(few, "k", "left_anti")
        # pairs that a join over columns makes, against all pairs
        joined = unit.where("o IS NOT NULL").groupBy("o").agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()[0]
        near = block_nearest(unit, n, asks) if joined > float(self.matrix.select("visitorid").distinct().count()) ** 2 else nearest_rows(unit, n, light, skip=few)
        # rows in order of their heads are in order of what fills a list first, so n + 1 rows hold the first n + 1 users
        near = near.union(asks.select("k", F.col("k").alias("same"), F.lit(1.0)))
        members = top_per(self.heads, ["head"], [F.asc("visitorid")], n + 1, "place").select(F.col("head").alias("b_head"), F.col("visitorid").alias("b"))
        filled = near.select(F.col("a").alias("head"), F.col("b").alias("b_head"), "sim").join(members, "b_head")
        self.lists = materialized(top_per(filled, ["head"], by_score("sim", "b"), n + 1).select("head", "rank", "b", "b_head", "sim"), "near")

    def pairs(self) -> DataFrame:
        """a, b, sim for every user."""
        each = self.heads.withColumnRenamed("visitorid", "a").join(self.lists, "head").where("a <> b")
        return top_per(each, ["a"], [F.asc("rank")], self.n, "place").select("a", "b", "sim")

    def recommend(self, n: int) -> DataFrame:
        """visitorid, itemid, score, rank. Users of one row have one of two lists: a neighbour of their own row is left out, or the last neighbour is."""
        within = self.lists.groupBy("head", "b_head").agg(F.any_value("sim").alias("sim"), F.count("*").alias("listed"), F.count_if(F.col("rank") <= self.n).alias("first"))
        ways = within.select("head", "b_head", "sim", F.explode(F.array(F.struct(F.lit(True).alias("within"), (F.col("listed") - (F.col("head") == F.col("b_head")).cast("int")).alias("m")), F.struct(F.lit(False).alias("within"), F.col("first").alias("m")))).alias("way"))
        ways = ways.select("head", "b_head", "sim", "way.within", "way.m").where("m > 0")
        mine = self.heads.join(self.lists.select("head", F.col("b").alias("visitorid"), F.lit(True).alias("within")), ["head", "visitorid"], "left").withColumn("within", F.coalesce("within", F.lit(False)))
        mine = materialized(mine, "mine")
        ways = ways.join(mine.select("head", "within").distinct(), ["head", "within"], "left_semi")
        rows = ways.join(self.matrix.withColumnRenamed("visitorid", "b_head"), "b_head").groupBy("head", "within", "itemid").agg(F.sum(F.col("sim") * F.col("m") * F.col("weight")).alias("score"))
        unseen = rows.join(self.matrix.select(F.col("visitorid").alias("head"), "itemid"), ["head", "itemid"], "left_anti")
        best = top_per(unseen, ["head", "within"], by_score("score", "itemid"), n)
        return mine.join(best, ["head", "within"]).select("visitorid", "itemid", "score", "rank")


def user_neighbours(matrix: DataFrame, neighbours: int = CF_NEIGHBOURS) -> DataFrame:
    """a, b, sim: the nearest users of each with enough interactions (the budget of neighbours + 1 counts the user)."""
    return UserNeighbours(matrix, neighbours).pairs()


def recommend_by_users(matrix: DataFrame, n: int = TOP_K, neighbours: int = CF_NEIGHBOURS, near: DataFrame | None = None) -> DataFrame:
    """visitorid, itemid, score, rank from the rows of the nearest users. ``near``: ``user_neighbours`` found before."""
    if near is None:
        return UserNeighbours(matrix, neighbours).recommend(n)
    rows = near.join(matrix.withColumnRenamed("visitorid", "b"), "b").groupBy(F.col("a").alias("visitorid"), "itemid").agg(F.sum(F.col("sim") * F.col("weight")).alias("score"))
    unseen = rows.join(matrix.select("visitorid", "itemid"), ["visitorid", "itemid"], "left_anti")
    return top_per(unseen, ["visitorid"], by_score("score", "itemid"), n).select("visitorid", "itemid", "score", "rank")
