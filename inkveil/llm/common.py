"""Shared helpers: tables in the cluster's shared folder, in-row bindings, defaults."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: U+0020 and U+0009 to U+000D.
WS = "\\x20\\x09-\\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.

    Where neither is set there is none, and a temporary folder of this machine would do only if all executors run on
    it: with a ``local`` master one is made, with any other this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_inkveil_shared", None)
    if not root:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = named.get() if named.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset: with master {master} it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkveil-shared-")
        spark._inkveil_shared = root
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/inkveil/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at a table that no lost executor takes along."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, column: str = "__llm_row") -> DataFrame:
    """``df``, stored, with a number for each row by which decisions find their way back: ids may be null or repeat."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), name)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or with the first number from 2 that makes it differ from all ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    return next(n for k in range(1, len(taken) + 2) if (n := name if k == 1 else f"{name}_{k}").lower() not in taken)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
