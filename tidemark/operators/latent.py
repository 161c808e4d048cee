"""Latent factors: truncated SVD of the interaction matrix by subspace iteration.

The matrix A (visitors x items) is dealt into blocks of visitors of some ``BLOCK_CELLS`` coordinates. A pass brings each block the factor rows
of the items that occur in it, multiplies by the block and by its transpose with numpy, and adds up what blocks say of an item: W = AᵀA V.
Only the small Gram matrix of W (factors x factors) comes to the driver, whose eigenvectors turn W into the next V, orthonormal and in the
order of singular values. Neither V nor a row of A is ever collected; each pass is written, so that a lost executor costs one pass at most.

Scores are products of packed blocks: a row for a block of users, one for a block of items, one product for each pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SEED, SVD_FACTORS, TOP_K
from ..functions.scoring import by_score, top_per
from ..sources.files import materialized
from .cooccurrence import excluded

#: Coordinates of a block of the matrix; items and users of a block of scores.
BLOCK_CELLS, BLOCK_ITEMS, BLOCK_USERS = 1 << 17, 4096, 2048
#: Columns carried beyond the wanted ones (and as many again as wanted), most passes, and the relative change of singular values at which
#: passes end.
SPARE, PASSES, SETTLED = 20, 20, 1e-13
#: Directions with less than this share of the greatest singular value (of AᵀA) are none.
NOTHING = 1e-7
SLICE = 1 << 14


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix, np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), flat)


def _times(to: np.ndarray, at: np.ndarray, weight: np.ndarray, factors: np.ndarray, n: int) -> np.ndarray:
    """Row ``to[i]`` of the result gains ``weight[i] * factors[at[i]]``; in slices, so that memory follows factors, not coordinates."""
    out = np.zeros((n, factors.shape[1]))
    order = np.argsort(to, kind="stable")
    for i in range(0, len(order), SLICE):
        part = order[i : i + SLICE]
        rows = to[part]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[starts]] += np.add.reduceat(weight[part, None] * factors[at[part]], starts, axis=0)
    return out


def _random(ids: np.ndarray, columns: int) -> np.ndarray:
    """Seeded values between -1 and 1 by item and column: the same wherever they are made."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(columns, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1.0


class Blocks:
    """The matrix in blocks of visitors (coordinates: block, visitorid, itemid, weight) and which items each block needs."""

    def __init__(self, matrix: DataFrame):
        n = max(1, -(-matrix.count() // BLOCK_CELLS))
        block = F.pmod(F.xxhash64("visitorid"), F.lit(n)).alias("block")
        self.cells = materialized(matrix.select(block, F.col("visitorid").cast("long").alias("visitorid"), F.col("itemid").cast("long").alias("itemid"), F.col("weight").cast("double").alias("weight")), "cells")
        self.needed = materialized(self.cells.select("block", "itemid").distinct(), "needed")

    def meet(self, factors: DataFrame, run, schema: str) -> DataFrame:
        """``run(key, cells, factors of their items)`` for each block. Its memory is that of the block's coordinates and its items' rows."""
        return self.cells.groupBy("block").cogroup(self.needed.join(factors, "itemid").groupBy("block")).applyInArrow(run, schema)


def _multiplied(turn: np.ndarray | None, columns: int):
    """One pass over a block: items' rows of AᵀA V, where V is random at first and then the rows of ``w`` times ``turn``."""

    def run(key, cells, rows):
        ids = rows["itemid"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        v = _random(ids, columns) if turn is None else _rows(rows["w"])[order] @ turn
        users, at = np.unique(cells["visitorid"].to_numpy(), return_inverse=True)
        to, weight = np.searchsorted(ids, cells["itemid"].to_numpy()), cells["weight"].to_numpy()
        u = _times(at, to, weight, v, len(users))
        return pa.table({"itemid": ids, "w": _lists(_times(to, at, weight, u, len(ids)))})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal items, which stand together, added up; the last item of a batch may go on in the next."""
    last, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, w = batch.column("itemid").to_numpy(), _rows(batch.column("w"))
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        ids, w = ids[starts], np.add.reduceat(w, starts, axis=0)
        if last is not None:
            if ids[0] == last:
                w[0] += total
            else:
                ids, w = np.concatenate(([last], ids)), np.concatenate((total[None], w))
        last, total = ids[-1], w[-1].copy()
        if len(ids) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1]), _lists(w[:-1])], ["itemid", "w"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([last])), _lists(total[None])], ["itemid", "w"])


def _gram(factors: DataFrame, columns: int, turn: np.ndarray | None = None) -> np.ndarray:
    """wᵀw, or that of w times ``turn``: a matrix of columns x columns for each of some tasks, added up."""

    def run(batches):
        out = np.zeros((columns, columns))
        for batch in batches:
            if batch.num_rows:
                w = _rows(batch.column("w"))
                w = w if turn is None else w @ turn
                out += w.T @ w
        yield pa.RecordBatch.from_arrays([_lists(out)], ["w"])

    parts = factors.select("w").coalesce(64).mapInArrow(run, "w array<double>").collect()
    return np.sum([np.array([p.w for p in parts]).reshape(-1, columns, columns)], axis=1)[0] if parts else np.zeros((columns, columns))


def item_factors(matrix: DataFrame, factors: int = SVD_FACTORS, blocks: Blocks | None = None) -> DataFrame:
    """itemid, v: the row of V for each item, the first ``factors`` right singular vectors (one less than items at most).

    Singular vectors are told apart as far as their values differ; of equal values any basis may come out, and scores do not depend on
    which. With few items (at most 2 * factors + ``SPARE``) the space is the whole one, and the result is that of a full decomposition."""
    blocks = blocks or Blocks(matrix)
    items = blocks.needed.select("itemid").distinct()
    n = items.count()
    k = min(factors, n - 1)
    if k < 1:
        return matrix.sparkSession.createDataFrame([], "itemid long, v array<double>")
    columns = min(n, 2 * k + SPARE)
    rows, turn, before = items, None, None
    for _ in range(PASSES):
        partial = blocks.meet(rows, _multiplied(turn, columns), "itemid long, w array<double>")
        rows = materialized(partial.repartition("itemid").sortWithinPartitions("itemid").mapInArrow(_added, "itemid long, w array<double>"), "pass")
        square, turned = np.linalg.eigh(_gram(rows, columns))
        square, turned = square[::-1], turned[:, ::-1]
        values = np.sqrt(np.maximum(square, 0))
        some = values > NOTHING * values[0] if values[0] > 0 else np.arange(len(values)) < 1
        turn, columns = turned[:, some] / np.where(values[some] > 0, values[some], 1), int(some.sum())
        values = values[some][:k]
        if before is not None and len(before) == len(values) and np.all(np.abs(values - before) <= SETTLED * values[0]):
            break
        before = values
    # the Gram matrix has the square of W's condition: what that cost is mended by one of the nearly orthonormal rows themselves
    square, turned = np.linalg.eigh(_gram(rows, columns, turn))
    last = (turn @ (turned / np.sqrt(np.maximum(square, 0.5))) @ turned.T)[:, :k]

    def turned_rows(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("itemid"), _lists(_rows(batch.column("w")) @ last)], ["itemid", "v"])

    return rows.mapInArrow(turned_rows, "itemid long, v array<double>")


def user_factors(matrix: DataFrame, items: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """visitorid, u: a user's row of A V."""

    def run(key, cells, rows):
        users, at = np.unique(cells["visitorid"].to_numpy(), return_inverse=True)
        ids = rows["itemid"].to_numpy()
        order = np.argsort(ids)
        known = np.isin(cells["itemid"].to_numpy(), ids)
        to = np.searchsorted(ids[order], cells["itemid"].to_numpy()[known])
        if not len(ids):
            return pa.table({"visitorid": pa.array([], pa.int64()), "u": pa.array([], pa.list_(pa.float64()))})
        return pa.table({"visitorid": users, "u": _lists(_times(at[known], to, cells["weight"].to_numpy()[known], _rows(rows["v"])[order], len(users)))})

    return (blocks or Blocks(matrix)).meet(items, run, "visitorid long, u array<double>")


def recommend(matrix: DataFrame, n: int = TOP_K, factors: int = SVD_FACTORS) -> DataFrame:
    """visitorid, itemid, score, rank: unseen items by the product of factors. The matrix, its blocks and the factors are made once and read by each step."""
    matrix = materialized(matrix, "matrix")
    blocks = Blocks(matrix)
    items = materialized(item_factors(matrix, factors, blocks), "item_factors")
    users = materialized(user_factors(matrix, items, blocks), "user_factors")
    return recommend_by_factors(matrix, items, users, n)


def recommend_by_factors(matrix: DataFrame, items: DataFrame, users: DataFrame, n: int = TOP_K) -> DataFrame:
    """``recommend`` with factors (itemid, v; visitorid, u) found before."""
    users = users.join(excluded(matrix, "visitorid"), "visitorid", "left_anti")
    seen = matrix.groupBy("visitorid").agg(F.sort_array(F.collect_list("itemid")).alias("seen"))
    best = block_products(users.join(seen, "visitorid"), items, n)
    return top_per(best, ["visitorid"], by_score("score", "itemid"), n).select("visitorid", "itemid", "score", "rank")


def _packed(key, rows):
    """A block's rows as one row of lists."""
    rows = rows.combine_chunks()
    names = [c for c in rows.column_names if c not in ("users", "items")]

    def whole(c):
        values = rows[c].chunk(0)
        if pa.types.is_list(values.type):
            values = values.cast(pa.list_(pa.field("element", values.type.value_type)))
        return pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), values)

    columns = {c: whole(c) for c in names}
    return pa.table({**{c: rows[c][:1] for c in ("users", "items") if c in rows.column_names}, **columns})


def block_products(users: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """visitorid, itemid, score: for each user (visitorid, u, seen) and block of items (itemid, v) the ``n`` best that are not seen. A pair of a
    block of users and one of items is a row, dealt by both their numbers, and one matrix product; ``n`` rows a user and block of items come out, not one a user
    and item. Scores are rounded to nine digits: with as many factors as the matrix has rank, unseen items have 0, not the noise of the last digits."""
    n_users, n_items = (max(1, -(-df.count() // size)) for df, size in ((users, BLOCK_USERS), (items, BLOCK_ITEMS)))
    packed_users = users.select(F.pmod(F.xxhash64("visitorid"), F.lit(n_users)).alias("users"), "visitorid", "u", "seen").groupBy("users").applyInArrow(_packed, "users long, visitorid array<long>, u array<array<double>>, seen array<array<long>>")
    packed_items = items.select(F.pmod(F.xxhash64("itemid"), F.lit(n_items)).alias("items"), "itemid", "v").groupBy("items").applyInArrow(_packed, "items long, itemid array<long>, v array<array<double>>")
    left = packed_users.withColumn("items", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_items - 1).cast("long"))))
    right = packed_items.withColumn("users", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_users - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i].values for c in ("visitorid", "u", "seen", "itemid", "v")}
                ids, visitors = np.asarray(value["itemid"]), np.asarray(value["visitorid"])
                order = np.argsort(ids)
                ids = ids[order]
                product = _rows(value["u"]) @ _rows(value["v"])[order].T
                seen, upto = np.asarray(value["seen"].flatten()), np.asarray(value["seen"].value_lengths())
                place = np.minimum(np.searchsorted(ids, seen), len(ids) - 1)
                hit = ids[place] == seen
                product[np.repeat(np.arange(len(visitors)), upto)[hit], place[hit]] = -np.inf
                # to nine digits equal scores go by id, as in any ranked list: all that reach the n-th best score are put in order
                rounded = np.round(product, 9) + 0.0
                least = np.partition(rounded, -n, axis=1)[:, -n] if len(ids) > n else np.full(len(visitors), -np.inf)
                rows, cols = np.nonzero((rounded >= least[:, None]) & (rounded > -np.inf))
                ranked = np.lexsort((cols, -rounded[rows, cols], rows))
                rows, cols = rows[ranked], cols[ranked]
                first = np.searchsorted(rows, rows)
                best = np.arange(len(rows)) - first < n
                yield pa.RecordBatch.from_arrays([pa.array(visitors[rows[best]]), pa.array(ids[cols[best]]), pa.array(rounded[rows[best], cols[best]])], ["visitorid", "itemid", "score"])

    pairs = left.join(right.hint("shuffle_hash"), ["users", "items"]).select("visitorid", "u", "seen", "itemid", "v")
    return pairs.mapInArrow(run, "visitorid long, itemid long, score double")


def explained_variance(matrix: DataFrame, factors: int = SVD_FACTORS) -> DataFrame:
    """factor, explained_variance_ratio, cumulative: variance of a factor's column over that of all item columns."""
    n_users = matrix.select("visitorid").distinct().count()
    mean, square = (lambda c: F.sum(c) / n_users), (lambda c: F.sum(F.col(c) * F.col(c)) / n_users)
    total = matrix.groupBy("itemid").agg((square("weight") - F.pow(mean("weight"), 2)).alias("v")).agg(F.sum("v").alias("total"))
    items = materialized(item_factors(matrix, factors), "item_factors")
    own = user_factors(matrix, items).select(F.posexplode("u").alias("factor", "x")).groupBy("factor").agg((square("x") - F.pow(mean("x"), 2)).alias("v"))
    return own.crossJoin(F.broadcast(total)).withColumn("explained_variance_ratio", F.col("v") / F.col("total")).withColumn("cumulative", F.sum("explained_variance_ratio").over(W.orderBy("factor"))).select("factor", "explained_variance_ratio", "cumulative")
