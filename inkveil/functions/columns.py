"""Column helpers: bindings within a row, and matches with their offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<text:string,start:int,end:int>>"
#: Matches that are gathered at once.
BLOCK = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str) -> Column:
    """All matches with their offsets in code points, ends exclusive, in time about linear in the text.

    Offsets are sums of the lengths of matches and of the gaps between them, so they hold for any script; a
    matcher's own offsets count UTF-16 units. The pattern must not match the empty string.
    """
    none = F.array().cast(SPANS)

    def spans(x: Column) -> Column:
        last = F.size(x["hits"]) - 1

        def step(acc: Column, i: Column) -> Column:
            a = acc["at"] + F.length(F.get(x["gaps"], i))
            b = a + F.length(F.get(x["hits"], i))
            found = F.struct(F.get(x["hits"], i).alias("text"), a.alias("start"), b.alias("end"))
            return F.struct(b.alias("at"), F.array_append(acc["out"], found).alias("out"))

        def block(acc: Column, begin: Column) -> Column:
            # Appending copies the array, so a run of matches is gathered by itself and appended as one.
            start = F.struct(acc["at"].alias("at"), none.alias("out"))
            run = F.aggregate(F.sequence(begin, F.least(begin + (BLOCK - 1), last)), start, step)
            return let(run, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), last, F.lit(BLOCK)), start, block, lambda acc: F.flatten(acc["out"]))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(let(F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("gaps")), spans)))


def overlaps(start: Column, end: Column, ranges: Column) -> Column:
    """Whether ``[start, end)`` meets any of ``ranges(start, end)``."""
    return F.exists(ranges, lambda r: (start < r["end"]) & (end > r["start"]))
