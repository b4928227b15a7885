"""Operators over all their input: nothing is left out by length, and rows are told apart without an id."""

from __future__ import annotations

from inkveil.llm import decontaminate, lines, mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def earliest_lines(rows):
    """``{doc_id: (n_units, n_removed, removed_chars, spans)}`` with every line that isn't blank."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        at, n, gone = 0, 0, []
        for line in (text or "").split("\n"):
            key = "".join(c.lower() if c.isascii() else c for c in " ".join(line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")))
            key = " ".join(w for w in key.split(" ") if w)
            if key:
                n += 1
                if key in seen:
                    gone.append((at, at + len(line)))
                seen.add(key)
            at += len(line) + 1
        out[doc_id] = (n, len(gone), sum(b - a for a, b in gone), ",".join(f"{a}:{b}" for a, b in gone))
    return out


def test_short_lines_are_removed(spark, sf, tmp_path):
    rows = [(0, "MIT License\nx\n\n \t"), (1, "mit  license\nX\n\n"), (2, None), (3, "a line that is longer than eight words is here\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), sf):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        got = {r["doc_id"]: tuple(r[c] for c in ("n_units", "n_removed", "removed_chars", "spans")) for r in queries.op6_line_dedup(spark, d).collect()}
        assert got == earliest_lines(docs)


def test_rows_without_id_decide_by_themselves(spark):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = [(None, f"so {item} so"), (None, "clean one"), (None, None), (1, item), (1, "clean two"), (2, "clean three")]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in texts], SCHEMA)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [texts[1], texts[2], texts[4], texts[5]]))


def test_mix_of_rows_without_id_meets_its_target(spark):
    ten = " ".join("abcdefghij")
    for key in (None, 7):
        docs = spark.createDataFrame([(key, f"{ten} {n}", "en", "s", None) for n in range(40)], SCHEMA)
        out = mixing.mixed(docs)
        assert out.columns == [*docs.columns, "copy_no"]
        rows = out.collect()
        assert len({(r["text"], r["copy_no"]) for r in rows}) == len(rows)
        assert abs(len(rows) * 11 - 40 * 11 * 1.5) <= 11  # one source: its target is SHARE of its words


def test_lines_of_rows_without_id_are_apart(spark):
    texts = ["once a\nboth x", "both x\nonce b", "once c\nboth x", "both x"]
    for key in (None, 7):
        docs = spark.createDataFrame([(key, t, "en", "s", None) for t in texts], SCHEMA)
        out = lines.dedup(docs)
        left = [line for r in out.collect() for line in r["text"].split("\n") if line]
        assert sorted(left) == ["both x", "once a", "once b", "once c"]
        got = lines.compared(docs).collect()
        assert sorted(r["n_units"] for r in got) == [1, 2, 2, 2] and sum(r["n_removed"] for r in got) == 3


def test_stages_of_odd_and_empty_tables(spark, sf, tmp_path):
    """Every stage takes nulls, repeated rows and clashing columns, and an empty table, and returns its input's columns."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    text = " ".join(f"the word{k} of" for k in range(40)) + "."
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text, None, None), (2, None, "en", "b"), (3, "", None, "b"), (4, text.replace("word", "thing"), "en", "b"), (4, text.replace("word", "other"), "en", "b")]
    docs = spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA)
    for c in ("row", "text_2", "fp", "rules", "key", "copy_no", "h", "size"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mixture" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), sf).count() == 0
        got = sorted(str(r["doc_id"]) for r in out.collect())
        if name == "near_duplicates":
            assert got == ["1", "2", "4", "4"]
        elif name in ("decontamination", "secret_scan"):
            assert got == sorted(str(r[0]) for r in rows)


def test_no_shared_folder_is_an_error(monkeypatch):
    from inkveil.llm import common

    class Option:
        isDefined = staticmethod(lambda: False)

    class Fake:
        def __init__(self, master):
            context = type("Sc", (), {"getCheckpointDir": staticmethod(lambda: Option)})
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
            self.sparkContext = type("Context", (), {"master": master, "_jsc": type("Jsc", (), {"sc": staticmethod(lambda: context)})})

    assert common.shared_dir(Fake("local[4]")).startswith("file:")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        try:
            common.shared_dir(Fake(master))
        except RuntimeError as e:
            assert "spark.checkpoint.dir" in str(e)
        else:
            raise AssertionError(master)
