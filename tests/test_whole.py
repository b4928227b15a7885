"""Queries over whole tables, held against brute force in Python: no document, item, length or token is left out."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa

from inkveil import queries
from inkveil.functions.fold import fold
from inkveil.operators import features


def rows_of(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_habit_in_every_language(spark, sf):
    got = {r["doc_id"]: (r["marks"], r["units"], r["bare_i"]) for r in queries.capitalisation_habit(spark, sf).collect()}
    want = {}
    for r in rows_of(spark, sf, "documents"):
        text, at, blank, heads = r["text"] or "", 0, True, []
        for line in text.split("\n"):
            bare = line.strip()
            if blank and 0 < len(bare) < 60 and bare[-1] not in ".!?":
                heads.append((at, at + len(line)))
            at, blank = at + len(line) + 1, not bare
        marks = [m.span() for m in re.finditer(r"(?<=[a-z,;:][ \t\n\x0b\f\r])[A-Z][a-z]{2,}", text)]
        marks = [m for m in marks if not any(m[0] < b and m[1] > a for a, b in heads)]
        units = [u for u in re.findall(r"[^.!?]+[.!?]*", text) if re.search(r"[^ \t\n\x0b\f\r]", u)]
        want[r["doc_id"]] = (len(marks), len(units), re.search(r"\bi\b", text) is not None)
    assert len({r["lang"] for r in rows_of(spark, sf, "documents")}) > 1 and got == want


def test_every_token_is_folded(spark, sf, tmp_path):
    rows = [(0, " the Café’s  owner\nZoë O’Brien–Smith's \u201cÅngström\u201d … James' end"), (1, None), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), sf):
        got = {r["doc_id"]: (r["n_tokens"], r["keys_md5"]) for r in queries.fold_names(spark, d).collect()}
        want = {}
        for r in rows_of(spark, d, "documents"):
            keys = [fold(t) for t in re.split(r"[ \t\n\r\f\x0b]+", r["text"] or "") if t]
            want[r["doc_id"]] = (len(keys), hashlib.md5(" ".join(keys).encode()).hexdigest())
        assert got == want


def test_all_documents_and_all_items_are_injected(spark, sf, tmp_path):
    docs = [(k, f"some text of document {k}, long enough") for k in range(120)] + [(120, None)]
    items = [(3 * k + 5, f"item {k}.") for k in range(57)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (str(tmp_path), sf):
        frames = [t for _, t in sorted((r["item_id"], r["text"]) for r in rows_of(spark, d, "benchmark"))]
        want = {}
        for r in rows_of(spark, d, "documents"):
            t, k = r["text"] or "", r["doc_id"]
            high, low = len(t) * 2 // 3, len(t) // 3
            first, second = frames[(k + 1) % len(frames)], frames[k % len(frames)]
            if high == low and k % len(frames) < (k + 1) % len(frames):  # in one slot, frames go by number
                first, second = second, first
            t = f"{t[:low]}{first} {t[low:high]}{second} {t[high:]}"
            want[k] = (hashlib.md5(t.encode()).hexdigest(), len(t))
        got = {r["essay_id"]: (r["text_md5"], r["n_chars"]) for r in queries.carrier_injection(spark, d).collect()}
        assert got == want


def test_titles_of_all_documents_and_lengths(spark, sf, tmp_path):
    eight = "one two three four five six seven eight"
    rows = [(1, f"{eight}\nThe Title\nx"), (2, f"say the title, then {eight} nine"), (3, None), (7, "one two three four\none two three four five six\nO’Brien won")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), sf):
        words = lambda s: [w.lower().replace("’", "'") for w in re.findall("[A-Za-z][A-Za-z'’-]*", s)]
        docs = {r["doc_id"]: r["text"] or "" for r in rows_of(spark, d, "documents")}
        titles = {tuple(w) for t in docs.values() for line in t.split("\n") if 2 <= len(w := words(line)) <= 8}
        assert {len(t) for t in titles} >= ({2, 4, 6, 8} if d != sf else set(range(2, 9)))
        want = set()
        for k, t in docs.items():
            ws = words(t)
            for at in range(len(ws)):
                if n := max((n for n in range(2, 9) if tuple(ws[at : at + n]) in titles and at + n <= len(ws)), default=0):
                    want.add((k, at, n))
        assert {(r["doc_id"], r["pos"], r["n"]) for r in queries.title_ngrams(spark, d).collect()} == want


def test_every_name_has_a_tier(spark, sf):
    plain = lambda s: s.lower().replace("#", " ").replace("_", " ")
    names = [(plain(r["n_name"]), ("place", "full_name", "title")[r["n_nationkey"] % 3]) for r in rows_of(spark, sf, "nation")]
    names += [(plain(r["r_name"]), "not_notable" if " " in r["r_name"] else ("iconic_short", "demonym")[r["r_regionkey"] % 2]) for r in rows_of(spark, sf, "region")]
    names += [(plain(r["c_name"]), ("full_name", "title")[r["c_custkey"] % 2]) for r in rows_of(spark, sf, "customer")]
    want = {t: (len(k), min(k), max(k)) for t in {t for _, t in names} if (k := [k for k, u in names if u == t])}
    assert {r["tier"]: (r["n"], r["low"], r["high"]) for r in queries.tier_lookup(spark, sf).collect()} == want
    assert queries._name_gazetteer(spark, sf).select("key").distinct().count() == len({k for k, _ in names})


def test_no_more_than_a_few_tokens_are_held_at_once(spark, tmp_path, monkeypatch):
    """Memory follows neither the texts of a batch nor the length of one; results don't depend on where they are cut."""
    rows = [(k, " ".join(f"Word{'abcdefg'[j % 7]} it's THE" for j in range(40))) for k in range(9)]
    docs = spark.createDataFrame([*rows, (9, None), (10, "")], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, features.tokens(docs).collect()))
    sizes = []
    caught = {}

    class Caught:
        schema = docs.schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: caught.update(run=run)  # noqa: E731, N815

    features.tokens(Caught())
    monkeypatch.setattr(features, "AT_ONCE", 7)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    got = []
    for out in caught["run"](iter([batch])):
        sizes.append(out.num_rows)
        got += [tuple(r.values()) for r in out.to_pylist()]
    assert max(sizes) == 7 and sorted(got) == whole and len(whole) == 9 * 120


def test_titles_move_no_more_than_their_matches(spark, tmp_path):
    """Tokens that begin a title but don't go on as one stay in their row: few n-grams reach the join."""
    rows = [(0, "the end of it\nthe last word")] + [(k, "the end " * 200) for k in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    titles = spark.createDataFrame([("the end of it",), ("the last word",), ("one",), (None,)], "key string")
    out = features.title_matches(docs, titles)
    assert sorted(map(tuple, out.collect())) == [(0, 0, 4), (0, 4, 3)]
    assert "Generate explode" not in out._jdf.queryExecution().analyzed().toString()
