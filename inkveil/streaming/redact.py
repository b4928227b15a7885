"""Redaction and counts on Structured Streaming sources. The plans are those of the batch: they work row by row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkveil.functions import patterns
from inkveil.plans.redaction import Redactor


def redact_stream(stream: DataFrame, redactor: Redactor, text_col: str = "text", identity_col: str | None = None) -> DataFrame:
    return redactor.redact_inbound(stream, text_col, identity_col)


def windowed(stream: DataFrame, by: list[str], time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "2 hours", values: dict[str, Column] | None = None) -> DataFrame:
    """Counts by tumbling (or, with ``slide``, sliding) window; rows later than ``late`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in (values or {}).items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", *(values or {}))


def sessions(stream: DataFrame, by: list[str], time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def kinds_by_window(stream: DataFrame, time: str = "ts", text_col: str = "text", **kw) -> DataFrame:
    """How many identifiers of each kind arrive by window."""
    found = F.concat(*(F.array_repeat(F.lit(p.kind), F.regexp_count(F.col(text_col), F.lit(p.regex))) for p in (patterns.EMAIL, patterns.URL, patterns.IP)))
    return windowed(stream.select(time, F.explode(found).alias("kind")), ["kind"], time, **kw)


def carried_keeps_stream(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Keeps carried from essays to their feedback on one stream.

    ``rows(doc_id string, role string, text string, keeps array<string>)``, ``role`` being ``inbound`` or ``outbound``. An
    inbound row writes its document's keeps to the state, an outbound row leaves with them; with ``ttl_ms`` state ends that
    long after the last row of its document (a query with such a timeout runs on until it is stopped). Within a micro-batch inbound rows of a document come first.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames))
        for keeps in pdf.loc[pdf["role"] == "inbound", "keeps"]:
            held = sorted({*held, *([] if keeps is None else keeps)})
        state.update((held,))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        out = pdf.loc[pdf["role"] == "outbound", ["doc_id", "text"]]
        yield out.assign(keeps=[held] * len(out))

    return rows.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id string, text string, keeps array<string>", "keeps array<string>", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, and read back what it wrote as Parquet below ``folder``, which all executors
    share. In ``complete`` mode each batch replaces the result, else it adds to it; a batch that is run again after a
    failure replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result" if mode == "complete" else f"{folder}/result/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result").select(*stream.columns)
