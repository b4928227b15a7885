"""SimHash near-duplicates: a self-join of binary tries of fingerprints, within a Hamming budget.

Texts are lower-cased (A-Z), cut into words at white space, and hashed by 4-word shingles (XXH64, seed 42); a bit of
the fingerprint is 1 if it is set in over half the hashes. Fingerprints link at ``BUDGET`` or fewer differing bits.

The join works on distinct fingerprints with their numbers of documents, so copies never meet as pairs. Of
``BUDGET + 1`` blocks of bits two linked fingerprints agree in one at least; each fingerprint goes to one bucket a
block. A bucket larger than ``SPLIT`` is not joined but split the same way by blocks of its remaining bits, twice at
most, so that a hot bucket becomes up to a hundred thousand others. In a bucket the fingerprints form a binary trie;
pairs of nodes are traversed together, level by level, with the bits in which they differ added up, and a pair is pruned
once its sum exceeds the budget. Of the blocks in which a pair agrees
the first counts it, so it counts once. A bucket returns, for each fingerprint, how many documents it links and one
edge of a spanning forest: no list of pairs leaves a task.

Defined results. Null and empty texts have no words: fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is the one shingle. Repeated rows and ids: each row counts as a document. Null doc_id: the
row takes part; ``component_id`` ignores it unless no row of the component has an id. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import drop_stored, numbered, partitions, stored
from inkveil.llm.components import components

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints in a bucket beyond which it is split by further blocks.
SPLIT = 4096
#: Levels of blocks. Each multiplies the rows of hot buckets by 5; a bucket that is still large has 31 or more bits in
#: common and is joined as it is, in pieces of ``FRONTIER`` node pairs.
LEVELS = 3
#: Node pairs that one traversal holds at once; larger frontiers are cut into pieces.
FRONTIER = 1 << 20
#: Fingerprints of whole buckets that a task joins at once.
RUN = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    line = b" ".join(text.lower().split())  # bytes: A-Z and ASCII white space only
    if not line:
        return 0
    ends = [*np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist(), len(line)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(ends) <= SHINGLE:
        return digest(line, SEED)
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], dtype="<u8")
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        values = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(values), pa.int64())], names=["doc_id", "fp"])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column(0)
        values = np.array([fingerprint(t.as_py() or b"") for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([doc.field(0), doc.field(1), doc.field(2), pa.array(_signed(values), pa.int64())], names=["row", "doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` as a signed 64-bit integer; one row a document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    return texts.mapInArrow(_hash, "doc_id bigint, fp bigint")


def blocks(free: int, parts: int) -> list[tuple[int, int]]:
    """``free`` bit places cut into ``parts`` runs ``(from, to)``, as even as can be."""
    cuts = [free * k // parts for k in range(parts + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:])]


def layout(path: tuple[int, ...]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """What a chain of block choices fixes. ``path``: the block chosen at each level.

    Returns for each level the mask of the chosen block, and the masks of the earlier blocks of that level, any of
    which would have counted the pair first; and the bit places still free.
    """
    free = list(range(64))
    levels = []
    for choice in path:
        runs = blocks(len(free), BUDGET + 1)
        masks = [sum(1 << free[i] for i in range(a, b)) for a, b in runs]
        levels.append((masks[choice], masks[:choice]))
        a, b = runs[choice]
        free = free[:a] + free[b:]
    return levels, free


def _pairs(values: np.ndarray, starts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``budget`` of the sorted, distinct fingerprints of each bucket.

    ``starts``: where the buckets begin, and the end. A node of a trie is a range of sorted values that share their
    leading bits; a frontier holds node pairs ``(a0, a1, b0, b1, differing bits)`` of one depth.
    """
    roots = np.stack([starts[:-1], starts[1:]], axis=1)
    roots = roots[roots[:, 1] - roots[:, 0] > 1]
    work = [(63, np.concatenate([roots, roots, np.zeros((len(roots), 1), np.int64)], axis=1))] if len(roots) else []
    while work:
        bit, front = work.pop()
        if len(front) > FRONTIER:
            work += [(bit, part) for part in np.array_split(front, len(front) // FRONTIER + 1)]
            continue
        # Small pairs are compared directly: the nodes below them would be single values anyway.
        small = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2]) <= 16
        if small.any() or bit < 0:
            done = front[small] if bit >= 0 else front
            na, nb = done[:, 1] - done[:, 0], done[:, 3] - done[:, 2]
            n = na * nb
            which = np.repeat(np.arange(len(done)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = done[which, 0] + k // nb[which], done[which, 2] + k % nb[which]
            keep = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if keep.any():
                yield i[keep], j[keep]
            front = front[~small] if bit >= 0 else front[:0]
        if not len(front):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a0, a1, b0, b1, d = front.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        kids = [
            np.stack([a0, am, b0, bm, d], axis=1),
            np.stack([am, a1, bm, b1, d], axis=1),
            np.stack([a0, am, bm, b1, d + 1], axis=1),
            np.stack([am, a1, b0, bm, d + 1], axis=1)[~same],
        ]
        front = np.concatenate(kids)
        work.append((bit - 1, front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3]) & (front[:, 4] <= budget)]))


def _counted(a: np.ndarray, b: np.ndarray, levels) -> np.ndarray:
    """Which pairs of a bucket it counts: those that agree in no earlier block of any level."""
    x = a ^ b
    keep = np.ones(len(x), bool)
    for _, earlier in levels:
        for mask in earlier:
            keep &= (x & np.uint64(mask)) != 0
    return keep


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index reachable from each of ``n`` nodes."""
    root = np.arange(n)
    if pairs:
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], low)
            np.minimum.at(new, root[j], low)
            new = new[new]
            if (new == root).all():
                return root
            root = new
    return root


def join_buckets(path: list[tuple[int, ...]], key: np.ndarray, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join many buckets at once; rows of a bucket have equal ``(path, key)``.

    Returns ``(fp, documents linked, root fp)`` of the fingerprints that have a link.
    """
    out = []
    for p in sorted(set(path)):
        at = np.flatnonzero(np.array([x == p for x in path], bool))
        levels, _ = layout(p)
        k, v, c = key[at], fp[at], n[at]
        order = np.lexsort((v, k))
        k, v, c = k[order], v[order], c[order]
        starts = np.concatenate([np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), [len(k)]])
        linked, tree = np.zeros(len(v), np.int64), []
        for i, j in _pairs(v, starts, BUDGET):
            keep = _counted(v[i], v[j], levels)
            i, j = i[keep], j[keep]
            np.add.at(linked, i, c[j])
            np.add.at(linked, j, c[i])
            tree = [(i, j)] if not tree else [*tree, (i, j)]
            if sum(len(t[0]) for t in tree) > 4 * FRONTIER:  # keep the forest, drop the pairs
                root = _forest(len(v), tree)
                tree = [(np.arange(len(v)), root)]
        root = _forest(len(v), tree)
        has = linked > 0
        out.append((v[has], linked[has], v[root[has]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64))


def _whole_buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by bucket, in runs of whole buckets: ``most`` rows, or as many more as the last bucket has."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        path, key = batch.column("path").to_pylist(), batch.column("key").to_numpy()
        begin = 0
        if held and size >= most:
            last = (held[-1].column("path")[-1].as_py(), held[-1].column("key")[-1].as_py())
            while begin < len(key) and (path[begin], key[begin]) == last:
                begin += 1
            if begin < len(key):
                yield pa.Table.from_batches([*held, batch.slice(0, begin)])
                held, size = [], 0
            else:
                begin = 0
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
            size += batch.num_rows - begin
    if held:
        yield pa.Table.from_batches(held)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of a partition, sorted by bucket, joined in runs of some ten thousand rows, never cut inside a bucket."""
    for table in _whole_buckets(batches, RUN):
        path = [tuple(map(int, p)) for p in table.column("path").to_pylist()]
        key, fp, n = (table.column(c).to_numpy() for c in ("key", "fp", "n"))
        v, linked, root = join_buckets(path, key, fp.view(np.uint64), n)
        for k in range(0, len(v), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(v[part])), pa.array(linked[part]), pa.array(_signed(root[part]))], names=["fp", "linked", "root"])


def _keys(path: tuple[int, ...]) -> list[tuple[str, int]]:
    """For each child of ``path``: its path, and the mask of all bits that it fixes (as a signed integer)."""
    out = []
    for choice in range(BUDGET + 1):
        child = (*path, choice)
        mask = sum(m for m, _ in layout(child)[0])
        out.append(("".join(map(str, child)), mask - (1 << 64) if mask >> 63 else mask))
    return out


def links(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """``(fp, linked, root)`` from ``distinct(fp, n)``: bucket by bucket, how many documents of other fingerprints each
    fingerprint links there, and a fingerprint to which it is connected."""
    spark = distinct.sparkSession
    n_out = partitions(spark)
    parts, depth, rows = [], 0, distinct.select(F.lit("").alias("path"), "fp", "n")
    while rows is not None:
        # A row for each child of the bucket that the row is in. There are at most 5 ** (depth + 1) children.
        paths = [r["path"] for r in rows.select("path").distinct().collect()] if depth else [""]
        masks = spark.createDataFrame([(p, c, m) for p in paths for c, m in _keys(tuple(map(int, p)))], "path string, child string, mask bigint")
        exploded = rows.join(F.broadcast(masks), "path").select(F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "n")
        hot = exploded.groupBy("path", "key").count().filter(F.col("count") > split).select("path", "key")
        hot = stored(hot, "hot-buckets")
        n_hot = hot.count()
        if n_hot and depth + 1 < LEVELS:
            # n_hot is at most 5 * rows / split; the join may broadcast it by its size, or else sorts.
            cool = exploded.join(hot, ["path", "key"], "left_anti")
            rows = stored(exploded.join(hot, ["path", "key"], "left_semi").select("path", "fp", "n"), "hot-rows")
        else:
            cool, rows = exploded, None
        parts.append(cool.repartition(n_out, "path", "key").sortWithinPartitions("path", "key").mapInArrow(_join, "fp bigint, linked bigint, root bigint"))
        depth += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, n_near, component_id)``, a row a document."""
    prints = stored(fingerprints(docs), "fingerprints")
    return prints.join(_clusters(prints), "fp").select("doc_id", "fp", "n_near", "component_id")


def _clusters(prints: DataFrame) -> DataFrame:
    """``(fp, n_near, component_id, root)``, stored: a row a fingerprint; ``root`` is the same throughout a component.

    Joined with ``prints``, a fingerprint's documents may be a third of all rows: they stay where they are if its row
    can be broadcast by size; otherwise the adaptive skew join splits them.
    """
    distinct = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "distinct")
    found = stored(links(distinct.select("fp", "n")), "links")
    # Nodes are fingerprints; what they reach least is found by fingerprint, then turned into the least doc_id.
    tree = components(found.filter("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("fp").agg(F.sum("linked").alias("linked"))
    node = tree.select(F.col("node").alias("fp"), "root")
    joined = distinct.join(linked, "fp", "left").join(node, "fp", "left").select("fp", "n", "first", F.coalesce("linked", F.lit(0).cast("bigint")).alias("linked"), "root")
    least = joined.filter("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    per = joined.join(least, "root", "left").select(
        "fp", (F.col("n") - 1 + F.col("linked")).alias("n_near"), F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("first"))).alias("component_id"), F.coalesce("root", "fp").alias("root"),
    )
    per = stored(per, "clusters")
    drop_stored(found)
    drop_stored(distinct)
    return per


def compared(docs: DataFrame) -> DataFrame:
    """The columns that the query op4 returns."""
    return cluster(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the one with the least doc_id, those without an id last.

    Rows that repeat an id are documents of their own; of equals the one whose text hashes least stays, so the choice
    doesn't depend on how the table is cut. The rows are numbered once, in a stored table. The numbers of
    those that go are stored, so that Spark knows their size: few are broadcast, and the texts stay where they are.
    """
    rows = numbered(docs, "simhash-docs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = rows.select("__llm_row", F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.encode(text, "UTF-8").alias("text"))
    prints = stored(base.select(F.struct("__llm_row", "doc_id", "h").alias("doc"), "text").mapInArrow(_hash_rows, "row bigint, doc_id bigint, h bigint, fp bigint"), "fingerprints")
    clusters = _clusters(prints.select("doc_id", "fp"))
    ranked = prints.join(clusters.select("fp", "root"), "fp").select("root", "row", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h", "row").alias("rank"))
    first = ranked.groupBy("root").agg(F.min("rank").alias("first"))
    # Only components of two rows or more lose any, so the join that finds the losers leaves single rows out.
    many = ranked.groupBy("root").count().filter("count > 1").select("root")
    losers = stored(ranked.join(first.join(many, "root"), "root").filter("row <> first.row").select(F.col("row").alias("__llm_gone")), "copies")
    drop_stored(prints)
    drop_stored(clusters)
    return rows.join(losers, rows["__llm_row"] == losers["__llm_gone"], "left_anti").drop("__llm_row")
