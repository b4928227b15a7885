r"""Benchmark decontamination: a stored positional inverted index of the training texts, searched for test windows.

1. :func:`build` cuts the texts into segments of ``SEGMENT_BYTES``, whole documents each, and stores, for every token
   of a segment, the list of its positions: a row ``(seg, term, n, positions)``. A row without a term describes
   the segment's documents. Lists are bounded by their segment, so no token, however frequent, makes one long list.
2. The windows of the benchmark are searched for in the index alone; the texts are not read again. Only lists of terms
   that windows use leave the table (a join with the terms, broadcast behind a bound), and meet by segment.
3. In a segment a window starts from the list of its rarest term (by the counts of the whole index), shifted
   by the term's place; each further list, from rare to common, is intersected with what is left, shifted likewise. What
   remains are the exact phrase occurrences. For proximity the rarest term's positions stay if all other terms of the
   window have a position within ``NEAR`` words.

Windows are taken in blocks of at most ``BLOCK_WINDOWS``: a block, not the benchmark, is what the driver and the
tasks hold; each further block is another pass over the index.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased. Defined results. Null or empty
text: no words, no hits. Empty tables: no rows, or no hits. An item with fewer words than a window is one window; one
without words is none. Item ids are a set: repeated rows of an item count once; a null item_id takes part in hits but is
not listed. Repeated documents: each row by itself. Other columns are never read by :func:`scan`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import numbered as with_numbers
from inkveil.llm.common import drop_stored, partitions, stored

WINDOW, NEAR = 10, 15
#: Most windows that are searched for at once (of ten words, some ten megabytes).
BLOCK_WINDOWS = 1 << 17
#: Bytes of document text in a segment, beyond which the next document starts another.
SEGMENT_BYTES = 2 << 20

_KEPT = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def _words(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


# --- the index

_INDEX = "seg bigint, term binary, n bigint, positions binary, ids array<bigint>"
_INDEX_ARROW = pa.schema([("seg", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("positions", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _blobs(values: np.ndarray, starts: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A binary array over ``values``' bytes, cut at ``starts`` (and the end)."""
    return pa.BinaryArray.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(values)])


def _segment(seg: int, ids: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of one segment. Positions count its tokens, with one place left free after each document, so that no
    phrase goes from one into the next; a list holds the differences of its positions, four bytes each."""
    vocabulary: dict[bytes, int] = {}
    number = vocabulary.setdefault
    bounds, parts = [0], []
    for text in texts:
        words = _words(text)
        parts.append(np.fromiter((number(w, len(vocabulary)) for w in words), np.int32, len(words)))
        bounds.append(bounds[-1] + len(words) + 1)
    edges = np.array(bounds, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([seg]), pa.array([None], pa.binary()), pa.array([len(ids)]), pa.array([edges.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], schema=_INDEX_ARROW)
    if not vocabulary:
        return
    tokens = np.concatenate(parts)
    places = np.arange(len(tokens), dtype=np.int32) + np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(edges) - 1)
    order = np.argsort(tokens, kind="stable")
    sizes = np.bincount(tokens, minlength=len(vocabulary))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    gaps = np.diff(places[order], prepend=np.int32(0)).astype("<i4")
    gaps[starts[:-1]] = places[order][starts[:-1]]
    terms = list(vocabulary)
    for a in range(0, len(terms), 1 << 14):
        b = min(len(terms), a + (1 << 14))
        lists = gaps[starts[a] : starts[b]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(b - a, seg)), pa.array(terms[a:b], pa.binary()), pa.array(sizes[a:b]), _blobs(lists, 4 * (starts[a : b + 1] - starts[a])), pa.nulls(b - a, pa.list_(pa.int64()))],
            schema=_INDEX_ARROW,
        )


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, ids, part, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py() or b""
                ids.append(i)
                part.append(raw)
                size += len(raw) + 1
                if size >= most:
                    yield from _segment(seg, ids, part)
                    seg, ids, part, size = seg + 1, [], [], 0
        if ids:
            yield from _segment(seg, ids, part)

    return run


def build(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index of ``docs(doc_id, text)``. ``doc_id`` may be null or repeat: documents keep their place in a segment."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    return stored(texts.mapInArrow(_segments(segment_bytes), _INDEX), "index", "zstd")


# --- the windows


class Windows:
    """The windows of some items, by length: term numbers in order, and the items that have each."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.by_window: dict[tuple[int, ...], set[str | None]] = {}

    def add(self, item: str | None, text: str | None) -> None:
        ids = [self.numbers.setdefault(w, len(self.numbers)) for w in _words((text or "").encode())]
        for k in range(max(1, len(ids) - self.window + 1) if ids else 0):
            self.by_window.setdefault(tuple(ids[k : k + self.window]), set()).add(item)

    @property
    def names(self) -> list[bytes]:
        return list(self.numbers)

    def close(self, counts: dict[int, int]) -> None:
        """Fix the arrays. ``counts``: how often each term is in the index; a window with a term that isn't is left out."""
        names = self.names
        rank = {t: k for k, t in enumerate(sorted(counts, key=lambda t: (counts[t], names[t])))}
        self.items = sorted({i for owners in self.by_window.values() for i in owners if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in self.by_window:
            if all(t in rank for t in w):
                by_length.setdefault(len(w), []).append(w)
        self.groups = {n: np.array(ws, np.int64).reshape(len(ws), n) for n, ws in by_length.items()}
        #: The places of each window's terms, rarest first.
        self.orders = {n: np.array([sorted(range(n), key=lambda k, w=w: (rank[w[k]], k)) for w in ws], np.int64).reshape(len(ws), n) for n, ws in by_length.items()}
        self.owners = {n: [sorted(number[i] for i in self.by_window[w] if i is not None) for w in ws] for n, ws in by_length.items()}
        self.used = sorted({t for ws in by_length.values() for w in ws for t in w})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("numbers", "by_window", "used")}


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Windows]:
    """The items' windows in blocks of about ``most`` (an item's windows stay together)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    block = Windows(window)
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if len(block.by_window) >= most:
            yield block
            block = Windows(window)
        block.add(row["item_id"], row["text"])
    yield block


# --- the search


class Lists:
    """The position lists of a segment: the sorted pairs of term and position, as one number each."""

    def __init__(self, terms: np.ndarray, lists: list[np.ndarray]):
        order = np.argsort(terms, kind="stable")
        self.terms = terms[order]
        parts = [lists[k] for k in order]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.pairs = np.concatenate([(int(t) << 32) + p for t, p in zip(self.terms, parts)]) if parts else np.empty(0, np.int64)

    def size(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == terms, self.sizes[at], 0) if len(self.terms) else np.zeros(terms.shape, np.int64)

    def starts_of_rarest(self, windows: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window whose terms all occur, its number with every position of its rarest term."""
        live = np.flatnonzero((self.size(windows) > 0).all(axis=1))
        term = windows[live, orders[live, 0]]
        at = np.searchsorted(self.terms, term)
        n = self.sizes[at]
        which = np.repeat(np.arange(len(live)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        position = self.pairs[(self.ends[at] - n)[which] + place] & 0xFFFFFFFF if len(which) else np.empty(0, np.int64)
        return live[which], position

    def phrases(self, windows: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and start positions of all exact occurrences."""
        which, position = self.starts_of_rarest(windows, orders)
        start = position - orders[which, 0] if len(which) else position
        which, start = which[start >= 0], start[start >= 0]
        for k in range(1, windows.shape[1]):
            if not len(which):
                break
            offset = orders[which, k]
            wanted = (windows[which, offset] << 32) + start + offset
            at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            keep = self.pairs[at] == wanted
            which, start = which[keep], start[keep]
        return which, start

    def near(self, windows: np.ndarray, orders: np.ndarray, bounds: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and positions of their rarest terms that have all other terms of the window within ``within``
        words in the same document."""
        which, position = self.starts_of_rarest(windows, orders)
        for k in range(1, windows.shape[1]):
            if not len(which):
                break
            doc = np.searchsorted(bounds, position, side="right") - 1
            term = windows[which, orders[which, k]] << 32
            low = np.searchsorted(self.pairs, term + np.maximum(position - within, bounds[doc]))
            high = np.searchsorted(self.pairs, term + np.minimum(position + within, bounds[doc + 1] - 2), side="right")
            which, position = which[low < high], position[low < high]
        return which, position


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, Lists]]:
    """The segments of sorted rows ``(seg, id, positions, ids)``, one at a time: number, document ids, bounds, lists."""
    now, ids, bounds, terms, lists = None, [], None, [], []
    for batch in batches:
        seg, term, blobs, docs = (batch.column(k) for k in range(4))
        for k, (s, t) in enumerate(zip(seg.to_pylist(), term.to_pylist())):
            if s != now:
                if now is not None:
                    yield now, ids, bounds, Lists(np.array(terms, np.int64), lists)
                now, terms, lists = s, [], []
            if t is None:
                ids, bounds = docs[k].as_py(), np.frombuffer(blobs[k].as_buffer(), np.int64)
            else:
                terms.append(t)
                lists.append(np.cumsum(np.frombuffer(blobs[k].as_buffer(), "<i4"), dtype=np.int64))
    if now is not None:
        yield now, ids, bounds, Lists(np.array(terms, np.int64), lists)


_FOUND = "seg bigint, place bigint, doc_id bigint, n_words bigint, items array<string>, near array<string>, spans array<array<bigint>>, near_at array<bigint>"


def _search(windows: Windows, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, ids, bounds, lists in _by_segment(batches):
            n_docs = len(ids)
            edge = np.zeros(int(bounds[-1]) + 1, np.int64)
            held: list[set[int]] = [set() for _ in range(n_docs)]
            close: list[set[int]] = [set() for _ in range(n_docs)]
            at_near: list[set[int]] = [set() for _ in range(n_docs)]
            for n, group in windows.groups.items():
                which, start = lists.phrases(group, windows.orders[n])
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n, -1)
                near_which, near_at = lists.near(group, windows.orders[n], bounds, within)
                for found, at, into in ((which, start, held), (near_which, near_at, close)):
                    docs = np.searchsorted(bounds, at, side="right") - 1
                    for d, w in set(zip(docs.tolist(), found.tolist())):
                        into[d].update(windows.owners[n][w])
                docs = np.searchsorted(bounds, near_at, side="right") - 1
                for d, p in zip(docs.tolist(), (near_at - bounds[docs]).tolist()):
                    at_near[d].add(p)
            covered = np.cumsum(edge[:-1]) > 0
            runs = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).reshape(-1, 2)
            owner = np.searchsorted(bounds, runs[:, 0], side="right") - 1
            spans: list[list[list[int]]] = [[] for _ in range(n_docs)]
            for d, span in zip(owner.tolist(), (runs - bounds[owner][:, None]).tolist()):
                spans[d].append(span)
            names = lambda sets: pa.array([sorted(windows.items[i] for i in x) for x in sets], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(
                {
                    "seg": pa.array(np.full(n_docs, seg)), "place": pa.array(np.arange(n_docs)), "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(bounds) - 1),
                    "items": names(held), "near": names(close), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "near_at": pa.array([sorted(x) for x in at_near], pa.list_(pa.int64())),
                }
            )

    return run


def _found(index: DataFrame, windows: Windows, within: int) -> DataFrame:
    """What a block of windows finds: a row a document of the index."""
    spark = index.sparkSession
    terms = lambda numbers: F.broadcast(spark.createDataFrame([(bytearray(windows.names[t]), t) for t in numbers], "word binary, id bigint"))
    lists = index.filter("term is not null")
    counts = lists.select("term", "n").join(terms(range(len(windows.names))), F.col("term") == F.col("word")).groupBy("id").agg(F.sum("n").alias("n"))
    windows.close({r["id"]: r["n"] for r in counts.collect()})  # a row a term of the block
    wanted = lists.join(terms(windows.used), F.col("term") == F.col("word")).select("seg", "id", "positions", "ids")
    laid = wanted.unionByName(index.filter("term is null").select("seg", F.lit(None).cast("bigint").alias("id"), "positions", "ids"))
    laid = laid.repartition(partitions(spark), "seg").sortWithinPartitions("seg", F.col("id").asc_nulls_first())
    return laid.mapInArrow(_search(windows, within), _FOUND)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, near, spans, near_at)``: a row a document of the index.

    ``items`` have a window that occurs, ``near`` one whose words lie within ``near`` words of its rarest, at the word
    numbers ``near_at``; ``spans`` are runs of hit words, as word numbers.
    """
    found, several = None, False
    for windows in _blocks(benchmark, window, block_windows):
        part = _found(index, windows, near)
        if found is not None:
            found, several = (found if several else stored(found, "block")).unionByName(stored(part, "block")), True
        else:
            found = part
    if several:
        united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = found.groupBy("seg", "place").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), united("items").alias("items"), united("near").alias("near"), united("spans").alias("spans"), united("near_at").alias("near_at"),
        )
        found = found.withColumn("spans", F.aggregate("spans", F.expr("cast(array() as array<array<bigint>>)"), _joined))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "near", "spans", "near_at")


def _joined(acc, span):
    """Sorted spans, with the next one joined to the last if they touch."""
    last = F.element_at(acc, -1)
    joins = (F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= span[0])
    grown = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(last[0], F.greatest(last[1], span[1])))
    return F.when(joins, grown).otherwise(F.array_append(acc, span))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, block_windows: int = BLOCK_WINDOWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """:func:`search` in the index of ``docs``."""
    return search(build(docs, segment_bytes), benchmark, window, near, block_windows)


def compared(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns that the query op5 returns; ``n_near`` counts the items with a proximity match."""
    return scan(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("bigint").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any exact hit, with all their columns.

    The rows are numbered once, in a stored table, and judged by number: each by itself, whatever its doc_id. The numbers
    of those that go are stored, so that Spark knows their size: few are broadcast, and the texts stay where they are.
    """
    rows = with_numbers(docs, "decontaminate-docs")
    index = build(rows.select(F.col("__llm_row").alias("doc_id"), "text"))
    hits = stored(search(index, benchmark, window).filter("n_hit > 0").select(F.col("doc_id").alias("__llm_hit")), "contaminated")
    drop_stored(index)
    return rows.join(hits, rows["__llm_row"] == hits["__llm_hit"], "left_anti").drop("__llm_row")
