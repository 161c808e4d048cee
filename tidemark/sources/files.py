"""CSV and Parquet sources and sinks, with early and plain errors."""

from __future__ import annotations

import functools
import logging
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("tidemark")

EVENTS = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("visitorid", T.LongType()), T.StructField("event", T.StringType()), T.StructField("itemid", T.LongType()), T.StructField("transactionid", T.LongType())])
ITEM_PROPERTIES = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("itemid", T.LongType()), T.StructField("property", T.StringType()), T.StructField("value", T.StringType())])
CATEGORY_TREE = T.StructType([T.StructField("categoryid", T.LongType()), T.StructField("parentid", T.LongType())])


def logger(name: str = "tidemark", level: int = logging.INFO) -> logging.Logger:
    out = logging.getLogger(name)
    if not out.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        out.addHandler(handler)
    out.setLevel(level)
    return out


def timed(f):
    """Logs how long building (not running) a plan took."""

    @functools.wraps(f)
    def wrapper(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            log.info("%s took %.3f s", f.__name__, time.perf_counter() - began)

    return wrapper


def require_columns(df: DataFrame, required, context: str = "table") -> DataFrame:
    """``df``, or a ValueError that names what is missing. Further columns are fine."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{context}: missing columns {missing}; there are {sorted(df.columns)}")
    return df


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, context: str = "table") -> DataFrame:
    """CSV files with a header as one table of the given schema, matched by position and checked against the header.

    A path that isn't there is a FileNotFoundError at once, not at the first action.
    """
    paths = [paths] if isinstance(paths, str) else paths
    try:
        header = spark.read.option("header", True).csv(paths[0])
        for p in paths[1:]:
            spark.read.option("header", True).csv(p)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{context}: no file at {paths}; put the raw CSV files there or generate sample data") from None
        raise
    require_columns(header, schema.fieldNames(), context)
    # read by name: extra columns and another order of columns are allowed
    names = header.columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(text).option("header", True).csv(paths)
    # whole numbers may be written as 1.0, as a column with gaps is by other tools
    return raw.select(*[(F.col(f.name).try_cast("double").cast(f.dataType) if isinstance(f.dataType, T.LongType) and f.name in ("transactionid", "parentid") else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema.fields])


def with_datetime(df: DataFrame) -> DataFrame:
    return df.withColumn("datetime", F.timestamp_millis("timestamp"))


def load_events(spark: SparkSession, path: str) -> DataFrame:
    return with_datetime(read_csv(spark, path, EVENTS, "events"))


def load_item_properties(spark: SparkSession, *paths: str) -> DataFrame:
    return with_datetime(read_csv(spark, list(paths), ITEM_PROPERTIES, "item_properties"))


def load_category_tree(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CATEGORY_TREE, "category_tree")


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three raw tables, lazily; the property log's two parts are one table."""
    return {
        "events": load_events(spark, f"{folder}/events.csv"),
        "item_properties": load_item_properties(spark, f"{folder}/item_properties_part1.csv", f"{folder}/item_properties_part2.csv"),
        "category_tree": load_category_tree(spark, f"{folder}/category_tree.csv"),
    }


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name. Models are saved the same way: a model is a set of tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the folder that driver and executors share and read again: computed once, with a short plan, and safe
    from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, one under /tmp in local runs, and an error on a cluster, whose machines share no /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"/tmp/tidemark-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def save_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
