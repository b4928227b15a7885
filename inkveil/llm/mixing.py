"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: all sources share ``SHARE`` of all words by weight; a target stops at ``MOST`` times its source's words, and
what is over goes to the others by weight until none is above. This is the level ``t`` at which the sum of
``min(most * size, t * weight)`` is the share, so one sort of the table of sources finds it.

A source's ratio of target to size is split: every document is taken ``floor(ratio)`` times, and once more with the
fraction ``p``. Which ones, the cube method decides: probabilities move along the null space of the constraints (words
taken, documents taken) until they are 0 or 1, so both totals stay as they are. A flight settles long texts first and leaves no
more than two documents, short ones, undecided. It runs in blocks of a source, so a source with a third of all rows is many blocks;
what blocks leave is gathered from ``FAN_IN`` blocks at a time and flown again, until one small landing problem a source
remains: of the at most four outcomes the one nearest to the totals is taken.

Defined results. Null or empty text: size 0, taken 0. Null source: a source of its own, the last in order. Rows with
equal or null doc_id are documents of their own. A source without words has target 0. Results don't depend on how the
table is cut into files or tasks: blocks, their order and their seeds follow from hashes of doc_id and text, and rows with
equal ones are interchangeable. Row numbers only carry decisions back.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import drop_stored, free_name, numbered, partitions, stored
from inkveil.llm.quality import word_array

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), (3, 2), 2, 20240501
#: Documents in a block, and blocks whose remains are gathered for one further flight.
BLOCK, FAN_IN = 8_192, 2_048
_EPS = 1e-9


def words(text: Column) -> Column:
    return F.size(word_array(F.coalesce(text, F.lit("")))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``(source, place, source_size, n_docs, target)`` from ``sizes(source, size)``: one row a source.

    The windows below order one row a source, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("*", place.alias("place")).withColumn("weight", F.get(F.lit(list(weights)), F.col("place") % len(weights)))
    cap = F.lit(most) * F.col("source_size")
    by_level = Window.orderBy(cap / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * share[0] / share[1]
    # The level if just the sources before this one were at their caps. Levels fall from the first that fits on.
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    per = per.select("*", level.alias("level"), (cap / F.col("weight")).alias("own"))
    t = F.max(F.when(F.col("level") <= F.col("own"), F.col("level"))).over(whole)
    target = F.least(cap.cast("double"), F.coalesce(t, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "place", "source_size", "n_docs", target.alias("target"))


def _step(p: np.ndarray, u: np.ndarray, rng: random.Random) -> np.ndarray:
    """Move along ``u``, either way with the probability that keeps the expectation, until an entry is 0 or 1."""
    with np.errstate(divide="ignore"):
        up = np.where(u > 0, (1 - p) / np.abs(u), np.where(u < 0, p / np.abs(u), np.inf)).min()
        down = np.where(u < 0, (1 - p) / np.abs(u), np.where(u > 0, p / np.abs(u), np.inf)).min()
    p = p + (up if rng.random() * (up + down) < down else -down) * u
    p[p < _EPS] = 0.0
    p[p > 1 - _EPS] = 1.0
    return p


def flight(size: np.ndarray, p: np.ndarray, rng: random.Random) -> np.ndarray:
    """``p`` with at most two entries still between 0 and 1; the sums of ``p`` and of ``size * p`` stay.

    Each move is the longest undecided text's, projected on the null space: the others give way a little each, in
    proportion to ``p (1 - p)``. So the long texts are settled while there are many short ones to make up for them.
    """
    out = p.copy()
    at = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    at = at[np.argsort(-size[at], kind="stable")]
    while len(at) > 1:
        q, x = out[at], size[at].astype(float)
        w = q * (1 - q)
        w[0] = 0
        n, s1, s2 = w.sum(), (w * x).sum(), (w * x * x).sum()
        det = n * s2 - s1 * s1
        if len(at) > 2 and det > 1e-9 * n * s2:
            u = w * ((s1 * x[0] - s2) + (s1 - n * x[0]) * x) / det
            u[0] = 1.0
        else:  # the others are as long as each other: two of them trade
            same = np.flatnonzero(x == x[-1])
            if len(same) < 2:
                break
            u = np.zeros(len(at))
            u[same[-2:]] = 1.0, -1.0
        out[at] = _step(q, u, rng)
        at = at[(out[at] > 0) & (out[at] < 1)]
    return out


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the last entries: the outcome nearest to the expected words, then to the expected number of documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best = None
    for code in range(1 << len(left)):
        bits = np.array([code >> i & 1 for i in range(len(left))], float)
        off = (abs(((bits - p[left]) * size[left]).sum()), abs((bits - p[left]).sum()), code)
        if best is None or off < best[0]:
            best = (off, bits)
    out = p.copy()
    out[left] = best[1]
    return out


def _fly(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "size", "p"], kind="stable")
        size = pdf["size"].to_numpy()
        p = flight(size, pdf["p"].to_numpy(), random.Random(f"{seed}:{':'.join(map(str, key))}"))
        return pdf.assign(p=landing(size, p) if last else p)[["row", "place", "block", "h", "size", "p"]]

    return run


_UNITS = "row bigint, place int, block bigint, h bigint, size bigint, p double"


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: int = SEED, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)``: a row a document, ``taken = copies * size``."""
    sizes = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = stored(targets(sizes, weights, share, most), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + _EPS)
    rows = sizes.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    rows = stored(
        rows.select("row", "doc_id", "h", "size", "source_size", "target", "place", "n_docs", whole.cast("bigint").alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("p")),
        "rated",
    )
    drop_stored(sizes)
    n_blocks = F.ceil(F.col("n_docs") / block)
    units = rows.filter(F.col("p") > _EPS).select("row", F.col("place").cast("int"), F.pmod("h", n_blocks).cast("bigint").alias("block"), "h", "size", "p")
    decided, most_blocks = [], sources.select(F.max(F.ceil(F.col("n_docs") / block)).alias("n")).first()["n"] or 1
    while True:
        last = most_blocks <= 1
        spread = units.repartition(partitions(docs.sparkSession), "place", "block")  # little data, much work: one task would do it
        flown = spread.groupBy("place", "block").applyInPandas(_fly(seed, last), _UNITS)
        if last:
            decided.append(flown.filter("p = 1"))
            break
        flown = stored(flown, "flown")
        decided.append(flown.filter("p = 1"))
        units = flown.filter("p > 0 and p < 1").select("row", "place", F.floor(F.col("block") / fan_in).cast("bigint").alias("block"), "h", "size", "p")
        most_blocks = -(-most_blocks // fan_in)
    taken = decided[0].select("row")
    for d in decided[1:]:
        taken = taken.unionByName(d.select("row"))
    joined = rows.join(taken.withColumn("more", F.lit(1)), "row", "left")
    copies = F.col("whole") + F.coalesce("more", F.lit(0))
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def compared(docs: DataFrame) -> DataFrame:
    """The columns that the query op2 returns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, numbered from 0 in ``copy_no`` (``copy_no_2``,
    and so on, where ``docs`` has such a column).

    The rows are numbered once, in a stored table, and taken by number: each by itself, whatever its doc_id.
    """
    rows = numbered(docs, "mixed-docs")
    taken = mix(rows.select(F.col("__llm_row").alias("doc_id"), "source", "text")).filter("copies > 0").select(F.col("doc_id").alias("__llm_taken"), F.col("copies").alias("__llm_n"))
    joined = rows.join(taken, rows["__llm_row"] == taken["__llm_taken"])
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__llm_n") - 1))
    return joined.select(*(rows[c] for c in docs.columns), numbers.alias(free_name("copy_no", docs.columns)))
