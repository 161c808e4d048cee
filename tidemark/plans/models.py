"""Models as sets of tables: fitted, saved as Parquet, loaded. The hybrid is none of its own: it is put together from the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import blend, cooccurrence, latent, rankings, vectors
from ..sources.files import load_tables, save_tables
from .catalogue import Shop

#: Tables of the models, and what each is looked up by.
KEYS = {
    "user_features": "visitorid", "item_features": "itemid", "category_features": "categoryid", "interactions": "visitorid", "content_members": "itemid", "content_vectors": "profile",
    "content_lists": "itemid", "item_similarities": "item", "user_neighbours": "a", "basket_pairs": "item_a", "item_factors": "itemid", "user_factors": "visitorid",
}
TABLES = tuple(KEYS)

#: Similar items that are saved of each.
NEIGHBOURS = 50


def fit(shop: Shop, neighbours: int = NEIGHBOURS) -> dict[str, DataFrame]:
    factors = latent.item_factors(shop.matrix)
    return {
        "user_features": shop.users, "item_features": shop.items, "category_features": shop.categories, "interactions": shop.matrix, **shop.content.tables(),
        "content_lists": shop.content.similar_items(neighbours), "item_similarities": cooccurrence.similar_items(shop.matrix, neighbours),
        "user_neighbours": cooccurrence.user_neighbours(shop.matrix), "basket_pairs": cooccurrence.pair_counts(shop.basket),
        "item_factors": factors, "user_factors": latent.user_factors(shop.matrix, factors),
    }


def train_and_save(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Tables are saved in ranges of their keys and sorted, so that a lookup reads the few files and row groups that may hold its key."""
    save_tables({name: df.repartitionByRange(KEYS[name]).sortWithinPartitions(KEYS[name]) for name, df in fit(Shop(spark, sf_dir)).items()}, folder)


class Recommender:
    """Serves from saved tables; every method answers for all users or items as one DataFrame. Lists and neighbours are read, not found anew."""

    def __init__(self, spark: SparkSession, folder: str):
        self.t = load_tables(spark, folder, *TABLES)
        self.content = vectors.ContentVectors(self.t["content_members"], self.t["content_vectors"])

    def trending(self, n: int = 10, category: int | None = None) -> DataFrame:
        return rankings.trending(self.t["item_features"], n, category)

    def bought_together(self, n: int = 10) -> DataFrame:
        return cooccurrence.bought_together(self.t["basket_pairs"], n)

    def _first(self, table: str, n: int) -> DataFrame:
        """The first ``n`` of saved lists; no more than were saved (``fit(neighbours=...)``) can be asked for."""
        most = self.t[table].agg({"rank": "max"}).first()[0] or 0
        if n > max(most, NEIGHBOURS):
            raise ValueError(f"{most} similar items were saved of each")
        return self.t[table].where(f"rank <= {int(n)}")

    def similar(self, n: int = 10) -> DataFrame:
        """The ``n`` items nearest by content."""
        return self._first("content_lists", n)

    def also_viewed(self, n: int = 10) -> DataFrame:
        """The ``n`` most similar items by who met them."""
        return self._first("item_similarities", n)

    def by_users(self, n: int = 10) -> DataFrame:
        return cooccurrence.recommend_by_users(self.t["interactions"], n, near=self.t["user_neighbours"])

    def by_factors(self, n: int = 10) -> DataFrame:
        return latent.recommend_by_factors(self.t["interactions"], self.t["item_factors"], self.t["user_factors"], n)

    def recommend(self, visitors: DataFrame, n: int = 10, **options) -> DataFrame:
        return blend.recommend(visitors, self.t["user_features"], self.t["item_features"], self.t["interactions"], self.content, n, **options)
