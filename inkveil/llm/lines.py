"""Substring dedup by line hashing: of equal lines anywhere in the corpus the earliest stays, the rest go.

Units are the lines (or paragraphs) of a text that aren't blank; with ``least`` only those of as many words or more.
A unit's key is the 128-bit digest of its text with A-Z lower-cased and white space made one space. The earliest unit is
the one with the least doc_id, then line number, then row. Keys are grouped with a partial minimum, so a line that a third of all
documents share sends one row a task; only units whose key occurs again meet their winner, in an equality join whose hot
keys the adaptive skew join splits. Offsets are code points of the original text, ends exclusive.

Defined results. Null or empty text: no units. Null doc_id ranks last. Rows are told apart by a number, so those that
repeat a doc_id or have none are documents of their own, and of equal lines one stays. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import free_name, numbered, stored

LEAST_WORDS = 1
_UNITS = "row bigint, doc_id bigint, line bigint, start bigint, stop bigint, d1 bigint, d2 bigint, n_units bigint"
_SPACE = re.compile("[\x20\x09-\x0d]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def units(text: str, separator: str = "\n", least: int = LEAST_WORDS) -> list[tuple[int, int, int, str]]:
    """``(line, start, stop, normalised)`` of the units of a text."""
    out, at = [], 0
    for line, part in enumerate(text.split(separator)):
        words = [w for w in _SPACE.split(part) if w]
        if len(words) >= least:
            out.append((line, at, at + len(part), " ".join(words).translate(_UPPER)))
        at += len(part) + len(separator)
    return out


def _map_units(separator: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "line", "start", "stop", "d1", "d2", "n_units"]
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = units(text.as_py() or "", separator, least)
                # A document without units keeps a row, so that the result has one for it.
                rows.append((row, doc_id, None, None, None, None, None, len(found)))
                for line, a, b, norm in found:
                    d = hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((row, doc_id, line, a, b, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), None))
                if len(rows) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return run


def removed(docs: DataFrame, separator: str = "\n", least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """The stored unit rows, and of them those to remove: ``(row, line, start, stop)``. ``docs`` has a number, ``__llm_row``."""
    texts = docs.select(F.col("__llm_row").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = stored(texts.mapInArrow(_map_units(separator, least), _UNITS), "units")
    real = every.filter("line is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("line").alias("line"), F.col("row").alias("row"))
    winners = real.groupBy("d1", "d2").agg(F.min(rank).alias("w"), F.count("*").alias("n")).filter("n > 1").select("d1", "d2", "w")
    losers = real.join(winners, ["d1", "d2"]).filter((F.col("row") != F.col("w.row")) | (F.col("line") != F.col("w.line")))
    return every, losers.select("row", "line", "start", "stop")


def compared(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The columns that the query op6 returns: a row a document, the removed spans with their original offsets."""
    # The numbers are fixed with the stored units; nothing goes back to the texts.
    every, gone = removed(docs.withColumn("__llm_row", F.monotonically_increasing_id()), least=least)
    lists = gone.groupBy("row").agg(
        F.count("*").alias("n_removed"), F.sum(F.col("stop") - F.col("start")).alias("removed_chars"),
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"),
    )
    rows = every.filter("line is null").select("row", "doc_id", "n_units")
    joined = rows.join(lists, "row", "left")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    zero = F.lit(0).cast("bigint")
    gone = F.coalesce("n_removed", zero)
    return joined.select("doc_id", (gone > 0).alias("repeats"), gone.alias("n_removed"), F.coalesce("removed_chars", zero).alias("removed_chars"), F.coalesce(spans, F.lit("")).alias("spans"), "n_units")


def dedup(docs: DataFrame, separator: str = "\n", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``, a separator with each, and ``removed_spans`` in offsets of the
    original (``removed_spans_2``, and so on, where ``docs`` has such a column). A null text stays null."""
    rows = numbered(docs, "lines-docs")
    _, gone = removed(rows, separator, least)
    lists = gone.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "start", "stop"))).alias("__llm_gone")).withColumnRenamed("row", "__llm_id")
    joined = rows.join(lists, rows["__llm_row"] == lists["__llm_id"], "left")
    numbers = F.transform("__llm_gone", lambda g: g["line"])
    kept = F.array_join(F.filter(F.split(rows["text"], F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")), -1), lambda _, i: ~F.array_contains(numbers, i.cast("bigint"))), separator)
    text = F.when(F.col("__llm_gone").isNull(), rows["text"]).otherwise(kept)
    return joined.select(*((text.alias(c) if c == "text" else rows[c]) for c in docs.columns), F.transform("__llm_gone", lambda g: F.struct(g["start"].alias("start"), g["stop"].alias("stop"))).alias(free_name("removed_spans", docs.columns)))
