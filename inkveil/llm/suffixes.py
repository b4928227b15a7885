"""Suffix-array dedup: remove bytes covered by strings of ``LENGTH`` bytes that occur more than once.

Sorting the suffix at every byte would ship each text some hundred times over, so the array is sparse, without losing
any match. A window of ``LENGTH`` bytes has an anchor: the place, among its first ``SPAN``, whose next eight bytes hash
least (the last of equals). It depends on the window's bytes alone, so equal windows have their anchors at the same
place, and all windows with one anchor, a run, share the bytes from the anchor over ``CORE`` bytes. The suffixes at
anchors are sorted:

1. Each run is a suffix: its leading eight bytes, a digest of its core, a digest of all bytes its windows cover.
2. Sampled splitters range-partition the suffixes, ties broken by document, so that even one string that a third of all
   documents share is spread over many buckets. A bucket sorts by multikey quicksort, word by word, and compares
   neighbours; groups that reach a bucket's first or last row are compared across the boundary, by one summary a bucket.
3. A suffix with no equal core elsewhere has no repeated window. One whose whole run is equal to another's is repeated
   throughout. Of the others (runs at the edge of a repeat), with one of each set of equal runs as partner, every window
   is digested and counted: how far a repeat reaches to the left and to the right differs from partner to partner, so
   the neighbours in the array don't settle it. Counts are partial sums, and the windows that occur again are found in
   an equality join, whose hot keys the adaptive skew join splits; they go on as bits, 63 windows a row.

Digests of windows have 128 bits, those of suffixes 64 after the eight leading bytes themselves, those of words 64; equal
digests count as equal bytes. Texts are told apart by a 128-bit digest too: rows with equal texts have equal results.

``reported`` also tells which texts hold a passage of ``PASSAGE`` words or more in a row that another row holds too, in
however many bytes and with whatever white space between words: the same array over words instead of bytes, where a
class of equal runs or windows counts only if it spans two rows. It removes nothing by that.

Defined results. Null text: as empty, nothing removed. Texts under ``LENGTH`` bytes keep all. Repeated rows, whatever
their ids: copies of each other, so of ``LENGTH`` bytes or more they go whole. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import drop_stored, partitions, stored

LENGTH, SPAN = 400, 160
CORE = LENGTH - SPAN + 1
#: Words of a passage that is reported as shared, and of its first part that may hold the anchor.
PASSAGE, PASSAGE_SPAN = 51, 36
PASSAGE_CORE = PASSAGE - PASSAGE_SPAN + 1
#: Bytes of a text handled at once; longer texts go in overlapping pieces.
PIECE = 1 << 19
#: Numbers in the bit table that tells which texts must move.
WORDS = 1 << 20


@cache
def _tables(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value a byte, and the powers of a base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(1000 + which)
    value = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 8 + 5
    base %= 1 << 64
    inverse = pow(base, -1, 1 << 64)
    n = PIECE + 2 * LENGTH
    power = np.full(n, base, np.uint64)
    power[0] = 1
    back = np.full(n, inverse, np.uint64)
    back[0] = 1
    return value, np.multiply.accumulate(power), np.multiply.accumulate(back)


class Digests:
    """Digests of any substring of a piece, from sums of ``value[byte] * base ** place`` modulo 2**64; a piece of
    numbers of 64 bits is taken as values."""

    def __init__(self, piece: np.ndarray, which: int):
        value, self.power, self.back = _tables(which)
        self.sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((value[piece] if piece.dtype == np.uint8 else piece) * self.power[: len(piece)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.back[a]
        return x ^ (x >> np.uint64(32))


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """For each place, where among the ``span`` grams from it the one that hashes least is."""
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << 20) - 1)
    key = (x & ~low) | (low - np.arange(len(x), dtype=np.uint64))
    step = 1
    while 2 * step <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < span:
        key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
    return (low - (key & low)).astype(np.int64)


def anchors(piece: np.ndarray) -> np.ndarray:
    """The anchor of the window at each of the piece's ``len - LENGTH + 1`` places."""
    grams = np.ndarray((len(piece) - 7,), "<u8", piece.tobytes(), strides=(1,))
    return _least(grams, SPAN)[: len(piece) - LENGTH + 1]


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_values(text: bytes) -> np.ndarray:
    """A digest of each word of a text, words being what white space parts."""
    raw = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(_BLANK[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    a, z = edges[::2], edges[1::2]
    out = np.empty(len(a), np.uint64)
    for at in range(0, len(raw), PIECE):
        i, j = np.searchsorted(a, [at, at + PIECE])
        end = np.minimum(z[i:j] - at, min(PIECE + LENGTH, len(raw) - at))
        out[i:j] = Digests(raw[at : at + PIECE + LENGTH], 0).of(a[i:j] - at, end)
    # A word that may go on beyond its piece.
    for k in np.flatnonzero(z - a > LENGTH):
        out[k] = int.from_bytes(hashlib.blake2b(text[a[k] : z[k]], digest_size=8).digest(), "big")
    return out


def _word_pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    words = word_values(text)
    for at in range(0, len(words) - PASSAGE + 1, PIECE):
        yield at, words[at : at + PIECE + PASSAGE - 1]


def word_runs(text: bytes) -> dict[str, np.ndarray]:
    """As ``runs``, of windows of ``PASSAGE`` words, counted in words; the suffix's leading words are two digests of the core."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("lead", "core", "seg", "s", "e")}
    for at, words in _word_pieces(text):
        grams = words[:-2] + words[1:-1] * np.uint64(0xD6E8FEB86659FD93) + words[2:] * np.uint64(0xA5A3564E27F8D2F5)
        anchor = _least(grams, PASSAGE_SPAN)[: len(words) - PASSAGE + 1]
        s = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        e = np.concatenate([s[1:] - 1, [len(anchor) - 1]])
        p = anchor[s]
        first, second = Digests(words, 1), Digests(words, 2)
        seg = first.of(s, e + PASSAGE) ^ ((p - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ ((p - e).astype(np.uint64) * np.uint64(0xA5A3564E27F8D2F5))
        for c, v in (("lead", first.of(p, p + PASSAGE_CORE)), ("core", second.of(p, p + PASSAGE_CORE)), ("seg", seg), ("s", s + at), ("e", e + at)):
            out[c].append(v)
    return {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}


def _pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
        yield at, raw[at : at + PIECE + LENGTH - 1]


def runs(text: bytes) -> dict[str, np.ndarray]:
    """The runs of a text of ``LENGTH`` bytes or more: first and last window, and the suffix's words."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("lead", "core", "seg", "s", "e")}
    for at, piece in _pieces(text):
        if len(piece) < LENGTH:
            continue
        anchor = anchors(piece)
        s = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        e = np.concatenate([s[1:] - 1, [len(anchor) - 1]])
        p = anchor[s]
        digests = Digests(piece, 0)
        lead = np.ndarray((len(piece) - 7,), ">u8", piece.tobytes(), strides=(1,))[p].astype(np.uint64) ^ np.uint64(1 << 63)
        # Where in its run the anchor lies is part of the run, so it is mixed into the digest.
        seg = digests.of(s, e + LENGTH) ^ ((p - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ ((p - e).astype(np.uint64) * np.uint64(0xA5A3564E27F8D2F5))
        for c, v in (("lead", lead), ("core", digests.of(p, p + CORE)), ("seg", seg), ("s", s + at), ("e", e + at)):
            out[c].append(v)
    return {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}


_RUNS = "lead bigint, core bigint, seg bigint, k1 bigint, k2 bigint, s bigint, e bigint"


def _map_runs(batches: Iterator[pa.RecordBatch], runs=runs) -> Iterator[pa.RecordBatch]:
    def batch(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        cols = {c: np.concatenate([p[c] for p in parts]) for c in ("lead", "core", "seg", "k1", "k2", "s", "e")}
        return pa.RecordBatch.from_pydict({c: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for c, v in cols.items()})

    for b in batches:
        parts, n = [], 0
        for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            r = runs(text.as_py())
            m = len(r["s"])
            if m:
                r["k1"], r["k2"] = np.full(m, k1, np.int64), np.full(m, k2, np.int64)
                parts.append(r)
            n += m
            if n > 1 << 17:
                yield batch(parts)
                parts, n = [], 0
        if n:
            yield batch(parts)


def _map_word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _map_runs(batches, word_runs)


#: Rows of a part that multikey quicksort hands to a plain sort.
SMALL = 1 << 12


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their words, first word first, by multikey quicksort: a part is cut in three by one word of a
    pivot; less and greater go on with the same word, equal with the next one."""
    order = np.arange(len(words[0]))
    parts = [(0, len(order), 0)]
    while parts:
        a, b, depth = parts.pop()
        if b - a < 2 or depth == len(words):
            continue
        rows = order[a:b]
        if b - a <= SMALL:
            order[a:b] = rows[np.lexsort([w[rows] for w in reversed(words[depth:])])]
            continue
        value = words[depth][rows]
        pivot = np.partition(value[:: max(1, len(value) // 99)], 49)[49] if len(value) > 99 else value[0]
        less, equal = value < pivot, value == pivot
        i, j = a + int(less.sum()), a + int(less.sum() + equal.sum())
        order[a:b] = np.concatenate([rows[less], rows[equal], rows[~less & ~equal]])
        parts += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


_BUCKET = _RUNS + ", pid int, edge boolean, whole boolean, first boolean, mixed boolean, many boolean"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket, compare neighbours. Rows of the first and last group, which may go on beyond the bucket, all stay;
    of the others those that are repeated throughout (``whole``) or need a closer look (``mixed`` and ``first``)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    cols = {c: table.column(c).to_numpy() for c in ("lead", "core", "seg", "k1", "k2", "s", "e")}
    order = multikey_order([cols["lead"], cols["core"], cols["seg"]])
    cols = {c: v[order] for c, v in cols.items()}
    new_group = np.concatenate([[True], (cols["lead"][1:] != cols["lead"][:-1]) | (cols["core"][1:] != cols["core"][:-1])])
    first = new_group.copy()
    first[1:] |= cols["seg"][1:] != cols["seg"][:-1]
    group, cls = np.cumsum(new_group) - 1, np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1
    whole = np.bincount(cls)[cls] > 1
    mixed = np.bincount(group, first)[group] > 1
    edge = (group == 0) | (group == group[-1])
    keep = np.flatnonzero(edge | whole | (mixed & first))
    pid = TaskContext.get().partitionId()
    for k in range(0, len(keep), 1 << 17):
        at = keep[k : k + (1 << 17)]
        yield pa.RecordBatch.from_pydict(
            {c: pa.array(v[at]) for c, v in cols.items()}
            | {"pid": pa.array(np.full(len(at), pid, np.int32))}
            | {c: pa.array(v[at]) for c, v in (("edge", edge), ("whole", whole), ("first", first), ("mixed", mixed), ("many", many))}
        )


def _across(sorted_runs: DataFrame, *columns: str) -> DataFrame:
    """The edge groups' rows, with what lies beyond their bucket taken into account.

    Two summaries a bucket at most come to the driver; what they say of each goes back with the plan.
    """
    spark = sorted_runs.sparkSession
    edge = sorted_runs.filter("edge")
    summary = sorted(edge.groupBy("pid", "lead", "core").agg(F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high")).collect(), key=lambda r: (r["pid"], r["lead"], r["core"]))
    rows = []
    for k, r in enumerate(summary):
        same = lambda x, r=r: (x["lead"], x["core"]) == (r["lead"], r["core"])
        back = k
        while back and same(summary[back - 1]):
            back -= 1
        on = k
        while on + 1 < len(summary) and same(summary[on + 1]):
            on += 1
        chain = summary[back : on + 1]
        rows.append(
            (r["pid"], r["lead"], r["core"], summary[k - 1]["high"] if back < k else None, summary[k + 1]["low"] if on > k else None,
             min(c["low"] for c in chain) != max(c["high"] for c in chain))
        )
    context = spark.createDataFrame(rows, "pid int, lead bigint, core bigint, before bigint, after bigint, mixed_all boolean")
    joined = edge.join(F.broadcast(context), ["pid", "lead", "core"])
    goes_back, goes_on = F.coalesce(F.col("seg") == F.col("before"), F.lit(False)), F.coalesce(F.col("seg") == F.col("after"), F.lit(False))
    return joined.select(
        "k1", "k2", "s", "e", *columns, (F.col("whole") | goes_back | goes_on).alias("whole"), (F.col("mixed_all") & F.col("first") & ~goes_back).alias("look")
    )


def _pairs(lists: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list of structs of two numbers, as an array of pairs each; none for null."""
    both = np.stack([lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)], axis=1)
    starts = lists.offsets.to_numpy()
    return (both[a:b] for a, b in zip(starts, starts[1:]))


_WINDOWS = "h1 bigint, h2 bigint, k1 bigint, k2 bigint, s bigint"


def _map_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the listed runs, digested."""
    for b in batches:
        for k1, k2, text, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), _pairs(b.column(3))):
            for at, piece in _pieces(text.as_py()):
                own = pairs[(pairs[:, 0] >= at) & (pairs[:, 0] < at + PIECE)] - at
                if not len(own):
                    continue
                n = own[:, 1] - own[:, 0] + 1
                s = np.repeat(own[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h1, h2 = (Digests(piece, w).of(s, s + LENGTH).view(np.int64) for w in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(s), k1)), pa.array(np.full(len(s), k2)), pa.array(s + at)], names=["h1", "h2", "k1", "k2", "s"])


def _map_word_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_map_windows``, of windows of words; where they are isn't told."""
    for b in batches:
        for k1, k2, text, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), _pairs(b.column(3))):
            for at, words in _word_pieces(text.as_py()):
                own = pairs[(pairs[:, 0] >= at) & (pairs[:, 0] < at + PIECE)] - at
                if not len(own):
                    continue
                n = own[:, 1] - own[:, 0] + 1
                s = np.repeat(own[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h1, h2 = (Digests(words, w).of(s, s + PASSAGE).view(np.int64) for w in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(s), k1)), pa.array(np.full(len(s), k2))], names=["h1", "h2", "k1", "k2"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint spans, touching ones joined."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.concatenate([first[1:] - 1, [len(spans) - 1]])]], axis=1)


#: Windows a row of bits has.
BITS = 63


def _map_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, whole, bits, shared in zip(b.column(0).to_pylist(), b.column(1), _pairs(b.column(2)), _pairs(b.column(3)), b.column(4).to_pylist()):
            block, place = np.nonzero((bits[:, 1, None] >> np.arange(BITS)) & 1)
            again = bits[block, 0] * BITS + place
            raw, cut = text.as_py(), merged(np.concatenate([whole, np.stack([again, again + LENGTH], axis=1)])).tolist()
            digest, at = hashlib.sha256(), 0
            for a, z in [*cut, (len(raw), len(raw))]:
                digest.update(raw[at:a])
                at = z
            rows.append((doc_id, len(raw), sum(z - a for a, z in cut), len(cut), digest.hexdigest(), cut, shared))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "shared_passage"])


def _listed(base: DataFrame, keys: DataFrame) -> DataFrame:
    """``base`` with ``listed``: false only where ``(k1, k2)`` is not in ``keys``.

    A bit table of fixed size, ``WORDS`` numbers of 64 bits at most whatever the input, goes to all tasks; texts it rules
    out needn't move. With very many keys it rules out fewer, which costs time, not results.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k2").bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.select(F.pmod("k1", F.lit(WORDS)).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held = F.call_function("shiftright", F.col("bits"), F.col("k2").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) != 0
    joined = base.withColumn("word", F.pmod("k1", F.lit(WORDS))).join(F.broadcast(bits), "word", "left")
    return joined.select(*base.columns, F.coalesce(held, F.lit(False)).alias("listed"))


def _base(docs: DataFrame) -> DataFrame:
    """The texts with their keys, ``(doc_id, text, k1, k2)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(text, "UTF-8").alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def _judged(long: DataFrame, map_runs, *columns: str) -> DataFrame:
    """Stored, the runs that have an equal one (``whole``) or need a closer look (``look``), with ``columns`` besides."""
    suffixes = stored(long.select("k1", "k2", "text").mapInArrow(map_runs, _RUNS), "suffixes")
    ranged = suffixes.repartitionByRange(partitions(long.sparkSession), "lead", "core", "seg", "k1", "s")
    found = stored(ranged.mapInArrow(_bucket, _BUCKET), "sorted")
    drop_stored(suffixes)
    inner = found.filter("not edge").select("k1", "k2", "s", "e", *columns, "whole", (F.col("mixed") & F.col("first")).alias("look"))
    judged = stored(inner.unionByName(_across(found, *columns)), "judged")
    drop_stored(found)
    return judged


def _to_look_at(long: DataFrame, judged: DataFrame) -> DataFrame:
    """``(k1, k2, text, spans)`` of the texts with runs that need a closer look."""
    look = judged.filter("look").groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    once = _listed(long, look).filter("listed").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return once.join(look, ["k1", "k2"]).select("k1", "k2", "text", "spans")


def repeated(base: DataFrame) -> DataFrame:
    """Stored, what is repeated in each text of ``_base``: ``(k1, k2, kind, a, b)``, of kind 0 the bytes from ``a`` to
    ``b``, of kind 1 windows, the bits of ``b`` counting from ``a * BITS``."""
    long = base.filter(F.octet_length("text") >= LENGTH)
    judged = _judged(long, _map_runs)
    whole = judged.filter("whole").select("k1", "k2", F.lit(0).alias("kind"), F.col("s").alias("a"), (F.col("e") + LENGTH).alias("b"))
    windows = _to_look_at(long, judged).mapInArrow(_map_windows, _WINDOWS)
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("s") % BITS).cast("int"))
    again = windows.join(twice, ["h1", "h2"], "left_semi").groupBy("k1", "k2", F.floor(F.col("s") / BITS).alias("a")).agg(F.bit_or(bit).alias("b"))
    found = stored(whole.unionByName(again.select("k1", "k2", F.lit(1).alias("kind"), "a", "b")), "spans")
    drop_stored(judged)
    return found


def shared(base: DataFrame) -> DataFrame:
    """Stored, the keys ``(k1, k2)`` of the texts of ``_base`` with ``PASSAGE`` words in a row that another row has too."""
    # So many words have one byte each and one between two at least.
    long = base.filter(F.octet_length("text") >= 2 * PASSAGE - 1)
    judged = _judged(long, _map_word_runs, "lead", "core", "seg")
    several = lambda df, *by: df.groupBy(*by).agg(*(f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("k1", "k2"))).filter("min_k1 != max_k1 or min_k2 != max_k2").select(*by)
    whole = judged.filter("whole")
    equal = whole.join(several(whole, "lead", "core", "seg"), ["lead", "core", "seg"], "left_semi")
    # Rows with equal texts have one key, and all their runs are whole.
    copies = whole.join(long.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"), ["k1", "k2"], "left_semi")
    windows = _to_look_at(long, judged).mapInArrow(_map_word_windows, "h1 bigint, h2 bigint, k1 bigint, k2 bigint")
    again = windows.join(several(windows, "h1", "h2"), ["h1", "h2"], "left_semi")
    keys = equal.select("k1", "k2").unionByName(copies.select("k1", "k2")).unionByName(again.select("k1", "k2"))
    found = stored(keys.distinct(), "shared")
    drop_stored(judged)
    return found


def _cut(base: DataFrame, found: DataFrame) -> DataFrame:
    """``dedup`` by what was found, with ``shared_passage`` where a row of kind 2 says so."""
    # A text's runs and rows of bits: a small part of its length each.
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("a", "b")))
    lists = found.groupBy("k1", "k2").agg(of(0).alias("whole"), of(1).alias("bits"), F.max(F.col("kind") == 2).alias("shared"))
    marked = _listed(base, found.select("k1", "k2"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>, shared_passage boolean"
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    never = F.lit(False)
    cut = marked.filter("listed").join(lists, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce("whole", none), F.coalesce("bits", none), F.coalesce("shared", never)).mapInArrow(_map_cut, schema)
    zero = F.lit(0).cast("bigint")
    whole = marked.filter("not listed").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
        F.array().cast("array<array<bigint>>").alias("spans"), never.alias("shared_passage"),
    )
    return cut.unionByName(whole)


def dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)``, a row a document; ``spans`` are the removed bytes."""
    base = _base(docs)
    return _cut(base, repeated(base)).drop("shared_passage")


def compared(docs: DataFrame) -> DataFrame:
    """What is removed, without the spans."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"))


def reported(docs: DataFrame) -> DataFrame:
    """The columns that the query op8 returns: those of ``compared``, and before them whether another row shares a passage."""
    base = _base(docs)
    passages = shared(base)
    zero = F.lit(0).cast("bigint")
    found = repeated(base).unionByName(passages.select("k1", "k2", F.lit(2).alias("kind"), zero.alias("a"), zero.alias("b")))
    return _cut(base, found).select("doc_id", "shared_passage", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"))
