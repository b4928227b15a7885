"""Evaluation runs, readers of documents, the service client, commands."""

from __future__ import annotations

import gzip
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from inkveil import __main__ as commands
from inkveil.functions.columns import located
from inkveil.operators import evaluate, features, names, tiers
from inkveil.operators.names import Options
from inkveil.plans import config, evaluation, redaction
from inkveil.queries import seed_gazetteer
from inkveil.sources import fixtures, gazetteer, readers


def test_arms(spark):
    text = spark.createDataFrame([("Then we met Imani Quist and Marie Curie, a@x.org.",)], "text string")
    got = {a: evaluation.arm(spark, a, seed_gazetteer(spark)).redact_inbound(text).first()["masked_text"] for a in ("local", "local-candidates", "path-gazetteer-lowercase", "stub")}
    assert got["local"] == "Then we met Imani Quist and Marie Curie, {EMAIL_1}."
    assert got["local-candidates"] == "Then we met {NAME_2} and {NAME_1}, {EMAIL_1}."
    assert got["path-gazetteer-lowercase"] == "Then we met {NAME_1} and Marie Curie, {EMAIL_1}." and "{EMAIL}" in got["stub"]
    with pytest.raises(evaluation.UnknownArm):
        evaluation.arm(spark, "nothing")
    assert evaluation.suffixed("local", Options(corroborate=False, headings=False)) == "local-nocorr-nohead"


def test_commands(spark, tmp_path, capsys):
    assert commands.main(["eval", "--strict"]) == 0
    out = capsys.readouterr().out
    assert "recall     all 100.0%" in out and "round trips 100.0%" in out
    path = str(tmp_path / "a.gz")
    gazetteer.write_text(seed_gazetteer(spark), path, {"cut": "x"})
    assert commands.main(["assets", "show", path]) == 0 and json.loads(capsys.readouterr().out)["meta"] == {"cut": "x"}
    manifest = tmp_path / "MANIFEST.json"
    manifest.write_text(json.dumps(readers.build_manifest(str(tmp_path), ["a.gz"])))
    assert commands.main(["assets", "verify", str(manifest)]) == 0
    with open(path, "ab") as f:
        f.write(b"x")
    assert commands.main(["assets", "verify", str(manifest)]) == 1
    spark.createDataFrame([(1, 0, "Then we met Imani Quist."), (2, 0, "Nobody came.")], "group_id int, field_no int, text string").write.parquet(str(tmp_path / "f.parquet"))
    capsys.readouterr()
    assert commands.main(["overfire", str(tmp_path / "f.parquet"), "--levels", "gazetteer"]) == 0
    assert "1 spans in 2 fields of 2 groups" in capsys.readouterr().out
    (tmp_path / "c.tsv").write_text("curie\t30\nquist\t70\n")
    assert commands.main(["census", str(tmp_path / "c.tsv"), "--least", "1"]) == 0
    assert "30.00% of 100 bearers" in capsys.readouterr().out


def test_groups_and_essays_match(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "group_id int, field_no int, text string")
    r = {"identity": redaction.build(spark, "local", level="identity")}
    for ids in ([1], [1, 2, 2], [1, 2, 3]):
        with pytest.raises(ValueError, match="essay"):
            evaluation.over_fire_levels(rows, spark.createDataFrame([(i, "x") for i in ids], "group_id int, text string"), r)


def test_misses_come_first(spark):
    label = lambda lit, keep: ("f " + lit, lit, "NAME", keep, None, False)
    cases = spark.createDataFrame([("1", "we met Imani Quist.", "", [label("Imani Quist", True), label("met", True)])], f"essay_id string, text string, base string, labels {evaluation.LABELS}")
    records = evaluation.run(cases, evaluation.arm(spark, "local-candidates"), "m").cache()
    assert [(r["frame"], r["passed"]) for r in evaluation.by_frame(records).collect()] == [("f Imani Quist [keep]", 0), ("f met [keep]", 1)]
    assert [(r["kind"], r["n"]) for r in evaluation.by_kind(records).collect()] == [("keep-destroyed", 1)]
    row = evaluation.summarize(records).first()
    assert row["precision_all"] == 50.0 and row["recall_all"] is None and "recall     all -" in evaluation.report(records)


def test_service_client(spark):
    class Upper:  # in here, so that tasks get it with the function
        """A service that answers in capitals what has a digit."""

        def apply(self, guardrail_id, version, source, content):
            assert (guardrail_id, version) == ("g", "2")
            return ("INTERVENED", [source + ":", content.upper()]) if any(c.isdigit() for c in content) else ("NONE", [])

    with pytest.raises(ValueError, match="client"):
        redaction.build(spark, "guardrail")
    r = redaction.build(spark, "guardrail", client=Upper, service_id="g", service_version="2")
    rows = spark.createDataFrame([(1, "a 1"), (2, "b"), (3, None), (4, " "), (5, "x1" * 600)], "doc_id int, text string")
    got = {x["doc_id"]: (x["masked_text"], x["intervened"], x["char_units"]) for x in r.redact_inbound(rows).collect()}
    assert got[1] == ("INPUT:A 1", True, 1) and got[2] == ("b", False, 1) and got[3] == (None, False, 0) and got[4] == (" ", False, 1) and got[5][2] == 2
    back = r.redact_outbound(rows, rows.limit(0)).collect()
    assert {x["doc_id"]: x["masked_text"] for x in back}[1] == "OUTPUT:A 1"


def test_documents_of_evaluation(spark, tmp_path):
    def doc(name, **value):
        (tmp_path / name).write_text(json.dumps({"version": 1, **value}))
        return str(tmp_path / name)

    frames = doc("f.json", frames=[{"frame_id": "a", "sentence": "x", "spans": [{"entity": "NAME", "literal": "x"}]}, {"frame_id": "b", "grp": "keep", "sentence": "y", "held_out": True, "spans": [{"entity": "NAME", "literal": "y", "verdict": "keep", "expect_count": 2}]}])
    got = {r["frame_id"]: (r["grp"], r["held_out"], [tuple(s) for s in r["spans"]]) for r in readers.frames_document(spark, frames).collect()}
    assert got == {"a": ("recall", False, [("x", "NAME", False, None)]), "b": ("keep", True, [("y", "NAME", True, 2)])}
    gates = readers.gates_document(spark, doc("g.json", gates=[{"gate": "r", "bar": 1.0}, {"gate": "o", "op": "<=", "bar": 2.0, "requires": "corpus"}]))
    assert sorted(map(tuple, gates.collect())) == [("o", "<=", 2.0, "corpus"), ("r", ">=", 1.0, None)]
    plan = doc("c.json", corpus="z", plan=[{"essay_id": "1", "base_sha256": "s", "frames": ["a"], "slots": [3]}])
    assert readers.carrier_document(spark, plan).first()["slots"] == [3]
    with pytest.raises(Exception, match="without slots"):
        readers.carrier_document(spark, doc("d.json", plan=[{"essay_id": "1", "frames": ["a"], "slots": []}])).collect()
    measured = doc("m.json", corpora={"z": {"recall": 100.0}})
    assert readers.measured_document(spark, measured, "z") == {"recall": 100.0}
    with pytest.raises(readers.SourceError, match="it has z"):
        readers.measured_document(spark, measured, "y")
    with pytest.raises(readers.SourceError, match="version 2"):
        readers.gates_document(spark, _version(tmp_path, 2))


def _version(folder, n):
    (folder / "v.json").write_text(json.dumps({"version": n, "gates": []}))
    return str(folder / "v.json")


def test_census_files(spark, tmp_path):
    raw = readers.encode_census([("b", 2), ("a", 1)])
    assert raw == readers.encode_census([("a", 1), ("b", 2)]) and readers.decode_census(raw) == [("a", 1), ("b", 2)]
    for bad in ("b\t1\na\t1\n", "a\t1\na\t1\n", "a\t0\n"):
        with pytest.raises(readers.SourceError):
            readers.decode_census(gzip.compress(bad.encode()))
    path = tmp_path / "c.tsv.gz"
    path.write_bytes(raw)
    digest = readers.build_manifest(str(tmp_path), ["c.tsv.gz"])["c.tsv.gz"]["sha256"]
    assert readers.census_surnames(spark, str(path), 1, digest).count() == 2
    with pytest.raises(readers.SourceError, match="pinned"):
        readers.census_surnames(spark, str(path), 1, "0" * 64)
    csv = "name,rank,count\nSMITH,1,10\nALL OTHER NAMES,0,99\nSMITH,2,4\n"
    (tmp_path / "u.csv").write_text(csv)
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("inner/names.csv", csv)
    for name in ("u.csv", "u.zip"):
        assert [tuple(r) for r in readers.census_upstream(spark, str(tmp_path / name), 1).collect()] == [("smith", 10)]


def test_settings_and_registers(spark, tmp_path):
    assert config.get("X", {}, {"X": " y "}) == "y" and config.get("X", {"X": "z"}, {"X": "y"}) == "z"
    assert config.is_production({config.DEPLOYMENT_VAR: "Blue"}, frozenset({"blue"})) and not config.is_production({config.DEPLOYMENT_VAR: "Blue"})
    registry = {"a": {"n": 1, "default": True}, "b": {"n": 2}}
    assert readers.resolve_corpus(None, registry, env={readers.CORPUS_VAR: "b"})["n"] == 2 and readers.resolve_corpus(None, registry, env={})["n"] == 1
    assert readers.latency_pair(env={})[0] is None and "unset" in readers.latency_pair(env={})[1]
    (tmp_path / "p.json").write_text('{"a": 1}')
    (tmp_path / "q.json").write_text("{")
    assert readers.latency_pair(str(tmp_path / "p.json")) == ({"a": 1}, None) and "can't be read" in readers.latency_pair(str(tmp_path / "q.json"))[1]
    assert "not there" in readers.latency_pair(str(tmp_path / "none"))[1]
    manifest = readers.build_manifest(str(tmp_path), ["p.json"])
    assert readers.verified_copy(manifest, str(tmp_path), str(tmp_path / "to")) == ["p.json"] and (tmp_path / "to/p.json").read_text() == '{"a": 1}'
    manifest["p.json"]["sha256"] = "0" * 64
    with pytest.raises(readers.SourceError):
        readers.verified_copy(manifest, str(tmp_path), str(tmp_path / "to"))


def test_labels_of_a_class_tree(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    entities = frame([(1, "A", 9), (2, "B", 9), (3, "C", 1), (4, None, 9), (5, "E", 9)], "id int, label string, links long")
    classes = frame([(1, "cat"), (2, "dog"), (3, "cat"), (4, "cat"), (5, "cat"), (5, "toy"), (1, "cat")], "id int, class string")
    tree = frame([("cat", "animal"), ("dog", "wolf"), ("animal", "thing"), ("thing", "cat"), ("toy", "made")], "class string, parent string")
    assert [tuple(r) for r in tiers.labels(entities, classes, tree, {"thing"}, 2, {"made"}).collect()] == [("A", 9)]


def test_matches_of_a_long_text(spark):
    text = "é Ab'c 😀 " * 30_000
    df = spark.createDataFrame([(1, text), (2, "x"), (3, ""), (3, "yy zz"), (3, "a bbb")], "doc_id int, text string")
    rows = df.select("doc_id", located(F.col("text"), "[A-Za-z']+").alias("m")).collect()
    assert [(m["text"], m["start"], m["end"]) for m in rows[0]["m"]] == [(m[0], m.start(), m.end()) for m in re.finditer("[A-Za-z']+", text)]
    toks = sorted((r["start"], r["token"]) for r in features.tokens(df).filter("doc_id = 3").collect())
    assert toks == [(0, "a"), (0, "yy"), (2, "bbb"), (3, "zz")]  # rows that share an id stay apart
    assert "Window" not in features.tokens(df)._jdf.queryExecution().toString()


def test_latency_without_gathering(spark):
    values = [5.0, 1.0, 1.0, 2.0, 9.0, 2.0, 2.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("c", None)], "arm string, ms double")
    ordered = sorted(values)
    got = {r["arm"]: tuple(r)[1:] for r in evaluate.latency(df, "arm", "ms").collect()}
    assert got == {"a": (7, ordered[int(7 * 0.5)], ordered[int(7 * 0.95)], 9.0), "b": (1, 3.0, 3.0, 3.0)}
    assert "collect_list" not in evaluate.latency(df, "arm", "ms")._jdf.queryExecution().toString()


def test_seed_is_in_every_tier():
    assert set(fixtures.SEED) == set(names.TIERS)
