"""What the corpus operators share: the shared folder, written intermediate tables, and Arrow settings."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Java pattern of what separates words.
GAP = r"[\x20\x09-\x0D]+"
#: The columns of ``documents``.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, else the context's own; where it is unset one
    under /tmp in local runs, and an error on a cluster, whose machines share no /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"/tmp/tidemark-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that no plan refers to any more. Spark deletes them when the driver collects its garbage, which it may not
    do for long; the second time finds what the first has made unreachable."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that very long texts do not gather in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def named(column: str) -> "F.Column":
    """The column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole(docs: DataFrame) -> "F.Column":
    """All columns of ``docs`` as a struct ``d``, so that no name of theirs meets one of an operator's."""
    return F.struct(*[named(c) for c in docs.columns]).alias("d")


def words_of(text) -> "F.Column":
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def has_word(text) -> "F.Column":
    return F.length(F.translate(text, " \t\n\x0b\f\r", "")) > 0
