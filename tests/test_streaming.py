from __future__ import annotations

from inkveil.plans import redaction
from inkveil.queries import seed_gazetteer
from inkveil.streaming import redact


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    r = redaction.build(spark, "local", seed_gazetteer(spark))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    got = redact.run_available(redact.redact_stream(stream, r).select("doc_id", "masked_text"), str(tmp_path / "out"))
    want = r.redact_inbound(spark.read.parquet(str(tmp_path / "in"))).select("doc_id", "masked_text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "t string").selectExpr("cast(t as timestamp) AS ts", "'a@x.org b@y.org' AS text")
    folder = str(tmp_path / "in")
    stream = spark.readStream.schema("ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(folder + "/*")
    for k, xs in enumerate([("2024-01-01 10:00:00",), ("2024-01-01 20:00:00",), ("2024-01-01 20:10:00",), ("2024-01-01 10:30:00", "2024-01-01 20:30:00"), ("2024-01-02 20:30:00",)]):
        rows(*xs).coalesce(1).write.parquet(f"{folder}/{k}")
    out = redact.run_available(redact.kinds_by_window(stream, width="1 hour", late="1 hour"), str(tmp_path / "out"))
    counts = {r["window_start"].hour: r["n"] for r in out.collect() if r["window_start"].day == 1}
    assert counts[10] == 2 and counts[20] == 6


def test_carry_on_a_stream(spark, tmp_path):
    rows = [("1", "inbound", "", ["curie"]), ("1", "outbound", "f", None), ("2", "outbound", "g", None)]
    spark.createDataFrame(rows, "doc_id string, role string, text string, keeps array<string>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, role string, text string, keeps array<string>").parquet(str(tmp_path / "in"))
    got = redact.run_available(redact.carried_keeps_stream(stream), str(tmp_path / "out"))
    assert sorted((r["doc_id"], list(r["keeps"])) for r in got.collect()) == [("1", ["curie"]), ("2", [])]
