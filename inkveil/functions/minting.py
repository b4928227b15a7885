"""Numbered placeholders: one counter a kind and document, shared by all passes, and reversible.

A document's state is a struct ``(text, minted, n)``: the text so far, what was minted in order as ``(kind, idx,
original)``, and how many replacements were made. The same original of a kind gets the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.columns import let

MINTED = "array<struct<kind:string,idx:int,original:string>>"


def initial(text: Column) -> Column:
    return F.struct(text.alias("text"), F.array().cast(MINTED).alias("minted"), F.lit(0).alias("n"))


def token(kind: Column, idx: Column) -> Column:
    return F.concat(F.lit("{"), kind, F.lit("_"), idx.cast("string"), F.lit("}"))


def number(minted: Column, kind: Column, original: Column) -> Column:
    """The number that ``original`` has or would get."""
    known = F.filter(minted, lambda m: (m["kind"] == kind) & (m["original"] == original))
    return F.coalesce(F.get(known, F.lit(0))["idx"], F.size(F.filter(minted, lambda m: m["kind"] == kind)) + 1)


def mint(minted: Column, kind: Column, original: Column) -> Column:
    """``(idx, minted)`` after minting ``original``."""
    fresh = lambda idx: F.array_append(minted, F.struct(kind.alias("kind"), idx.alias("idx"), original.alias("original")))
    known = lambda idx: F.exists(minted, lambda m: (m["kind"] == kind) & (m["idx"] == idx))
    return let(number(minted, kind, original), lambda idx: F.struct(idx.alias("idx"), F.when(known(idx), minted).otherwise(fresh(idx)).alias("minted")))


def substitute(state: Column, kind: str, pattern: Column | str, needs: tuple[str, ...] = (), accept: Callable[[Column], Column] | None = None, inner: str | None = None, numbered: bool = True) -> Column:
    """The state after replacing each match of ``pattern``, left to right.

    ``accept`` may leave a match as it is. With ``inner`` only the first match of that pattern within the match is
    replaced and minted. ``needs``: fragments of which a text that matches has one.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    name = F.lit(kind)

    def rewrite(x: Column) -> Column:
        start = F.struct(F.array(F.get(x["gaps"], F.lit(0))).alias("out"), x["minted"].alias("minted"), x["n"].alias("n"))

        def step(acc: Column, i: Column) -> Column:
            hit, gap = F.get(x["hits"], i), F.get(x["gaps"], i + 1)
            core = hit if inner is None else F.regexp_extract(hit, inner, 0)
            plain = F.struct(F.concat(acc["out"], F.array(hit, gap)).alias("out"), acc["minted"].alias("minted"), acc["n"].alias("n"))

            def replaced(m: Column) -> Column:
                mark = token(name, m["idx"]) if numbered else F.lit("{" + kind + "}")
                if inner is not None:
                    at = F.instr(hit, core)
                    mark = F.concat(F.substring(hit, F.lit(1), at - 1), mark, F.substring(hit, at + F.length(core), F.length(hit)))
                return F.struct(F.concat(acc["out"], F.array(mark, gap)).alias("out"), m["minted"].alias("minted"), (acc["n"] + 1).alias("n"))

            done = let(mint(acc["minted"], name, core), replaced)
            return done if accept is None else F.when(accept(hit), done).otherwise(plain)

        end = lambda acc: F.struct(F.array_join(acc["out"], "").alias("text"), acc["minted"].alias("minted"), acc["n"].alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1), start, step, end)

    def run(s: Column) -> Column:
        hits = F.regexp_extract_all(s["text"], rx, F.lit(0))
        full = lambda h: F.struct(h.alias("hits"), F.split(s["text"], rx, -1).alias("gaps"), s["minted"].alias("minted"), s["n"].alias("n"))
        found = let(hits, lambda h: F.when(F.size(h) > 0, let(full(h), rewrite)).otherwise(s))
        ready = F.lit(True) if isinstance(pattern, str) else rx.isNotNull() & (rx != "")
        if needs:
            some = F.contains(s["text"], F.lit(needs[0]))
            for n in needs[1:]:
                some = some | F.contains(s["text"], F.lit(n))
            ready = ready & some
        return F.when(ready, found).otherwise(s)

    return let(state, run)


def restore_map(minted: Column) -> Column:
    return F.map_from_entries(F.transform(minted, lambda m: F.struct(token(m["kind"], m["idx"]), m["original"])))


def restore(text: Column, minted: Column) -> Column:
    """Originals put back, longest placeholder first."""
    entries = F.transform(minted, lambda m: F.struct(token(m["kind"], m["idx"]).alias("t"), m["original"].alias("o")))
    longest = F.array_sort(entries, lambda a, b: F.length(b["t"]) - F.length(a["t"]))
    return F.aggregate(longest, text, lambda acc, e: F.replace(acc, e["t"], e["o"]))
