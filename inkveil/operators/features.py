"""Document features as columns: tokens, headings, emphasis, capitals, habit, title n-grams, surnames.

Offsets come from within the row. Token rows carry no text: a text a token would multiply what is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.columns import let, located, overlaps
from inkveil.functions.lexicon import LANDMARK_SUFFIXES, ORG_SUFFIXES, stop_words
from inkveil.operators.names import HEADING

TOKEN = "[A-Za-z][A-Za-z'’-]*"
#: Tokens that an Arrow function holds at once.
AT_ONCE = 1 << 16
#: Bits of the filter of titles, as a power of two, and of each of the parts it is made in.
FILTER, PART = 28, 16


def tokens(docs: DataFrame, pattern: str = TOKEN, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, token, start, end)``, all from within the row: nothing is shuffled, and rows that repeat an id stay apart.

    Running offsets within an array take interpreted lambdas, which cost four times what one pass of a regular expression
    over an Arrow batch does (5.2 s and 1.4 s for 400,000 tokens on two cores), so this is an Arrow function. It returns
    ``AT_ONCE`` tokens at a time, however many a batch or a text has.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(pattern)
        for batch in batches:
            own, pos, found, start, end = lists = [], [], [], [], []

            def rows() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(own, pa.int32()))  # noqa: B023 - called in this turn only
                arrays = [ids, pa.array(pos, pa.int32()), pa.array(found, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]  # noqa: B023
                for x in lists:  # noqa: B023
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "pos", "token", "start", "end"])

            for k, text in enumerate(batch.column(1)):
                for n, m in enumerate(rx.finditer(text.as_py() or "")):
                    own.append(k)
                    pos.append(n)
                    found.append(m[0])
                    start.append(m.start())
                    end.append(m.end())
                    if len(own) == AT_ONCE:
                        yield rows()
            yield rows()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, pos int, token string, start int, end int")


def is_stop(token: Column) -> Column:
    """Whether a token, without one clitic and outer quotes, is an ordinary word."""
    word = F.trim(F.lower(token), F.lit(".,"))
    bare = F.regexp_replace(word, "(?<=.)(?:n['’]t|['’](?:re|ve|ll|s|m|d|t))$", "")
    return F.trim(bare, F.lit("'’")).isin(sorted(stop_words()))


def headings(text: Column) -> Column:
    """``array<(start, end)>`` of short lines after a blank one, or first, that don't end a sentence."""
    lines = F.split(text, "\n", -1)

    def walk(ls: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("blank"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc: Column, line: Column) -> Column:
            bare = F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")
            head = acc["blank"] & (F.length(bare) > 0) & (F.length(bare) < HEADING) & ~bare.rlike("[.!?]$")
            end = acc["at"] + F.length(line)
            out = F.when(head, F.array_append(acc["out"], F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(acc["out"])
            return F.struct((end + 1).alias("at"), (F.length(bare) == 0).alias("blank"), out.alias("out"))

        return F.aggregate(ls, start, step, lambda acc: acc["out"])

    return let(lines, walk)


def mid_capitals(text: Column, heads: Column) -> Column:
    """How many capitalised words follow a lower-case letter or ``, ; :`` and one space, outside headings."""
    found = located(text, "(?<=[a-z,;:]\\s)[A-Z][a-z]{2,}")
    return F.size(F.filter(found, lambda m: ~overlaps(m["start"], m["end"], heads)))


def habit(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, marks, openings, bare_i, units, habit)``: how each document uses capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), headings(text).alias("heads"))
    low = F.regexp_count("text", F.lit("(?:\\A|(?<=[.!?]\\s))\\s*[a-z]"))
    units = F.size(F.filter(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda u: u.rlike("\\S")))
    out = base.select("doc_id", mid_capitals(F.col("text"), F.col("heads")).alias("marks"), low.alias("openings"), F.col("text").rlike("\\bi\\b").alias("bare_i"), units.alias("units"))
    often = F.col("bare_i") | (F.col("openings") / F.greatest(F.lit(1), F.col("units")) >= 0.10)
    some = F.col("bare_i") | (F.col("openings") > 0)
    return out.withColumn(
        "habit", F.when(F.col("marks") >= 2, F.when(often, "inconsistent").otherwise("consistent")).otherwise(F.when(some, "lowercase").otherwise("silent"))
    )


def capital_runs(toks: DataFrame) -> DataFrame:
    """``(doc_id, start, end, n)``: maximal runs of all-capital tokens, by the difference of two row numbers."""
    caps = (F.length("token") > 1) & (F.upper("token") == F.col("token")) & (F.lower("token") != F.col("token"))
    flagged = toks.filter(caps)
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return flagged.withColumn("g", island).groupBy("doc_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("g")


def organisation_kind(name: Column, settlement: Column | None = None) -> Column:
    """LOCATION, ORGANIZATION, LANDMARK (kept) or NAME, by the first row that holds."""
    words = F.filter(F.split(name, "\\s+"), lambda w: w != "")
    last = F.trim(F.lower(F.element_at(words, -1)), F.lit(".,"))
    town = F.lit(False) if settlement is None else settlement
    return (
        F.when(town, "LOCATION").when(last.isin(sorted(ORG_SUFFIXES)), "ORGANIZATION")
        .when((F.size(words) > 1) & last.isin(sorted(LANDMARK_SUFFIXES)), "LANDMARK").otherwise("NAME")
    )


class _Words(dict):
    """64-bit digests of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = out = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return out


def _filter_bits(words: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length to ``most`` the two bits of the filter of the n-gram at each word from which so many are left."""
    run = np.zeros(len(words) + 1, np.uint64)
    for n in range(1, min(most, len(words)) + 1):
        run = run[: len(words) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]
        mixed = (run ^ (run >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        yield n, mixed >> np.uint64(64 - FILTER), (mixed >> np.uint64(64 - 2 * FILTER)) & np.uint64((1 << FILTER) - 1)


def _title_filter(keys: DataFrame, least: int, most: int) -> bytes:
    """A Bloom filter of ``keys(key)``: of a fixed size, made in parts by as many groups, so the driver gets no keys."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _Words()
        for batch in batches:
            out = []
            for key in batch.column(0):
                words = (key.as_py() or "").split(" ")
                if least <= len(words) <= most:
                    *_, (_, one, two) = _filter_bits(np.array([digests[w] for w in words], np.uint64), most)
                    out += [int(one[0]), int(two[0])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["bit"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.zeros(1 << PART, np.uint8)
                part[found.values.to_numpy()] = 1
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    rows = keys.select(F.col("key").cast("string")).mapInArrow(bits, "bit bigint")
    grouped = rows.groupBy(F.shiftright("bit", PART).cast("int").alias("part")).agg(F.collect_set(F.col("bit").bitwiseAND((1 << PART) - 1).cast("int")).alias("found"))
    out, size = bytearray(1 << (FILTER - 3)), 1 << (PART - 3)
    for row in grouped.mapInArrow(parts, "part int, bits binary").collect():
        out[row["part"] * size : (row["part"] + 1) * size] = row["bits"]
    return bytes(out)


def title_matches(docs: DataFrame, titles: DataFrame, least: int = 2, most: int = 8, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, n)``: at each token the longest title that starts there. ``titles(key)``.

    N-grams that the filter of the titles doesn't know never leave their row; the others, hardly more than the titles that
    are there, carry their words and meet the titles by a join on them. Digests only filter, so the result is exact.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keys = titles.select("key").distinct()
    known = docs.sparkSession.sparkContext.broadcast(_title_filter(keys, least, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx, digests, bits = re.compile(TOKEN), _Words(), np.frombuffer(known.value, np.uint8)
        has = lambda at: (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

        def grams(ids: pa.Array, words: list[str], own: list[int], pos: list[int], left: list[int]) -> pa.RecordBatch:
            room = np.array(left, np.int64)
            out: list[tuple[int, int]] = []
            for n, one, two in _filter_bits(np.fromiter(map(digests.__getitem__, words), np.uint64, len(words)), most):
                if n >= least:
                    at = np.flatnonzero((room[: len(one)] >= n) & (has(one) == 1))
                    out += [(k, n) for k in at[has(two[at]) == 1].tolist()]
            arrays = [ids.take(pa.array([own[k] for k, _ in out], pa.int32())), pa.array([pos[k] for k, _ in out], pa.int32()), pa.array([n for _, n in out], pa.int32()), pa.array([" ".join(words[k : k + n]) for k, n in out], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "pos", "n", "key"])

        for batch in batches:
            words, own, pos, left = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                if found := rx.findall(text.as_py() or ""):
                    words += "\n".join(found).lower().replace("’", "'").split("\n")
                    own += [k] * len(found)
                    pos += range(len(found))
                    left += range(len(found), 0, -1)
                if len(words) >= AT_ONCE:
                    yield grams(batch.column(0), words, own, pos, left)
                    words, own, pos, left = [], [], [], []
            yield grams(batch.column(0), words, own, pos, left)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, pos int, n int, key string")
    return rows.join(keys, "key", "left_semi").groupBy("doc_id", "pos").agg(F.max("n").alias("n"))


def tier_of(names: DataFrame, gazetteer: DataFrame, particles: list[str]) -> DataFrame:
    """``names(key)`` with ``tier``: one join on the key, then the order of the tiers."""
    flags = gazetteer.groupBy("key").agg(*(F.max((F.col("tier") == t).cast("int")).alias(f"is_{t}") for t in ("full", "short", "place", "title", "demonym")))
    joined = names.join(flags, "key", "left")
    words = F.split("key", " ")
    has = lambda t: F.coalesce(F.col(f"is_{t}"), F.lit(0)) == 1
    tier = (
        F.when(F.length("key") == 0, "not_notable").when(has("place"), "place")
        .when(F.size(words) == 1, F.when(has("short"), "iconic_short").when(has("demonym"), "demonym").otherwise("not_notable"))
        .when((F.size(words) <= 3) & words[0].isin(particles) & has("short"), "iconic_short")
        .when(has("full"), "full_name").when(has("title"), "title").otherwise("not_notable")
    )
    return joined.select(*names.columns, tier.alias("tier"))


def corroborated(spans: DataFrame, full: DataFrame) -> DataFrame:
    """``spans(doc_id, start, key)`` that are one word and the surname of a full name in the same document; ``full(key)``."""
    many = spans.filter(F.size(F.split("key", " ")) > 1).join(full.select("key").distinct(), "key", "left_semi")
    forms = many.select("doc_id", F.element_at(F.split("key", " "), -1).alias("form")).distinct()
    return spans.filter(F.size(F.split("key", " ")) == 1).join(forms.withColumnRenamed("form", "key"), ["doc_id", "key"], "left_semi")
