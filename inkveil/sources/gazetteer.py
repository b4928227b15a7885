"""The tiered gazetteer as text (format 5) and as a table ``gazetteer(tier, key)``."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.operators.names import TIERS

FORMAT = 5


class AssetError(ValueError):
    """An asset that is missing, cut short, or of another format."""


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(tier, key)`` from an asset file. Header, tier names and counts are checked. Save the result as Parquet.

    The tier of a line is that of the last ``#!tier`` line before it. A gzip file is one split, so its lines keep their order.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    mark = F.when(F.col("value").startswith("#!tier "), F.split("value", " ")[1])
    count = F.when(F.col("value").startswith("#!tier "), F.split("value", " ")[2].cast("long"))
    rows = lines.select("value", F.last(mark, ignorenulls=True).over(Window.orderBy("n")).alias("tier"), count.alias("declared"))
    rows = rows.cache()
    try:
        head = rows.filter(F.col("value").startswith("#!gazetteer")).first()
        if head is None:
            raise AssetError(f"{path}: no format header")
        if int(head["value"].split()[1]) != FORMAT:
            raise AssetError(f"{path}: format {head['value'].split()[1]}, not {FORMAT}")
        keys = rows.filter(~F.col("value").startswith("#!") & (F.length("value") > 0) & F.col("tier").isNotNull())
        found = {r["tier"]: r["count"] for r in keys.select("tier", F.col("value").alias("key")).distinct().groupBy("tier").count().collect()}
        for r in rows.filter("declared is not null").select("tier", "declared").collect():
            if r["tier"] not in TIERS:
                raise AssetError(f"{path}: unknown tier {r['tier']!r}")
            if found.get(r["tier"], 0) != r["declared"]:
                raise AssetError(f"{path}: tier {r['tier']} declares {r['declared']} keys, has {found.get(r['tier'], 0)}")
    finally:
        rows.unpersist()
    return keys.select("tier", F.col("value").alias("key")).distinct()


def describe(spark: SparkSession, path: str) -> dict:
    """The header alone: format, meta, keys by tier."""
    heads = [r["value"] for r in spark.read.text(path).filter(F.col("value").startswith("#!")).collect()]
    words = [h[2:].split(" ", 1) for h in heads]
    return {
        "format": next((int(w[1]) for w in words if w[0] == "gazetteer"), None),
        "meta": next((json.loads(w[1]) for w in words if w[0] == "meta"), {}),
        "tiers": {w[1].split()[0]: int(w[1].split()[1]) for w in words if w[0] == "tier"},
    }


def write_text(gazetteer: DataFrame, path: str, meta: dict) -> int:
    """Write the asset: tiers and keys in order, no time stamp, so equal tables give equal bytes. Returns the size."""
    counts = {r["tier"]: r["count"] for r in gazetteer.distinct().groupBy("tier").count().collect()}
    with open(path, "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", compresslevel=9, mtime=0) as out:
        out.write(f"#!gazetteer {FORMAT}\n#!meta {json.dumps(meta, sort_keys=True)}\n".encode())
        now = None
        for r in gazetteer.select("tier", "key").distinct().orderBy("tier", "key").toLocalIterator():
            if r["tier"] != now:
                now = r["tier"]
                out.write(f"#!tier {now} {counts[now]}\n".encode())
            out.write(f"{r['key']}\n".encode())
    return Path(path).stat().st_size


def counts(gazetteer: DataFrame) -> DataFrame:
    """``(tier, n, most_tokens)``: the keys of each tier and the words of its longest."""
    return gazetteer.distinct().groupBy("tier").agg(F.count("*").alias("n"), F.max(F.size(F.split("key", " "))).alias("most_tokens"))


def from_dict(spark: SparkSession, tiers: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(t, k) for t, ks in tiers.items() for k in ks], "tier string, key string")
