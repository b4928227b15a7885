"""The structured pass: identifiers replaced by numbered placeholders, in an order that is part of the meaning.

Order: email and URL, then the writer's own identity, then the other patterns, payment cards with their checksum, postal
codes, ages. Each step reads the text the step before wrote. All of it is one projection over the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import minting, patterns
from inkveil.functions.lexicon import AMBIGUOUS_GIVEN, AMBIGUOUS_SURNAMES
from inkveil.functions.patterns import WORD

IDENTITY = "struct<first_name:string,last_name:string,school_name:string,extra_names:array<string>>"


def luhn(match: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(match, "\\D", ""))


def literal_pattern(literal: Column) -> Column:
    """A case-insensitive expression for a whole token, possessive tail included; null for null or blank.

    A boundary is asserted only at a side where the literal has a word character.
    """
    name = F.trim(literal)
    escaped = F.regexp_replace(name, f"([^{WORD}\\s])", "\\\\$1")
    lead = F.when(name.rlike(f"^[{WORD}]"), F.lit(f"(?<![{WORD}])")).otherwise("")
    trail = F.when(name.rlike(f"[{WORD}]$"), F.lit(f"(?![{WORD}])")).otherwise("")
    return F.when(F.length(name) > 0, F.concat(F.lit("(?iu)"), lead, escaped, F.lit("(?:['’]s|s['’])?"), trail))


def acronym_pattern(school: Column) -> Column:
    """The school's initials where there are three or more, in capitals as written."""
    words = F.regexp_extract_all(school, F.lit(f"[A-Za-z][{WORD}'-]*"), F.lit(0))
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.length(initials) >= 3, F.concat(F.lit("\\b"), initials, F.lit("\\b")))


def identity_steps(identity: Column) -> list[tuple[str, Column]]:
    """Kind and pattern column of each identity step but the extra names, most specific first."""
    first, last = F.trim(identity["first_name"]), F.trim(identity["last_name"])
    some = (F.length(first) > 0) & (F.length(last) > 0)
    return [
        ("NAME", F.when(some, literal_pattern(F.concat_ws(" ", first, last)))),
        ("NAME", F.when(some, literal_pattern(F.concat_ws(", ", last, first)))),
        ("NAME", F.when(~F.lower(last).isin(sorted(AMBIGUOUS_SURNAMES)), literal_pattern(last))),
        ("NAME", F.when(~F.lower(first).isin(sorted(AMBIGUOUS_GIVEN)), literal_pattern(first))),
    ]


def steps(identity: Column | None = None, numbered: bool = True) -> list:
    """The pass as functions from state to state, in order."""

    def fixed(p: patterns.Pattern, **kw):
        return lambda s: minting.substitute(s, p.kind, p.regex, p.needs, numbered=numbered, **kw)

    def dynamic(kind: str, rx: Column):
        return lambda s: minting.substitute(s, kind, rx, numbered=numbered)

    out = [fixed(p) for p in patterns.BEFORE_IDENTITY]
    if identity is not None:
        out += [dynamic(kind, rx) for kind, rx in identity_steps(identity)]
        extra = F.coalesce(identity["extra_names"], F.array().cast("array<string>"))
        out.append(lambda s: F.aggregate(extra, s, lambda acc, name: minting.substitute(acc, "NAME", literal_pattern(name), numbered=numbered)))
        school = F.trim(identity["school_name"])
        out += [dynamic("SCHOOL", literal_pattern(school)), dynamic("SCHOOL", acronym_pattern(school))]
    out += [fixed(p) for p in patterns.AFTER_IDENTITY]
    return [*out, fixed(patterns.CARD, accept=luhn), fixed(patterns.ZIP), fixed(patterns.AGE, inner="\\d{1,2}")]


def with_state(docs: DataFrame, text: Column, identity: Column | None = None, numbered: bool = True, name: str = "__state") -> DataFrame:
    """``docs`` with the state after the pass over ``text``, which must not be null; a column a step keeps plans shallow."""
    out = docs.withColumn(name, minting.initial(text))
    for step in steps(identity, numbered):
        out = out.withColumn(name, step(F.col(name)))
    return out


def mask_structured(docs: DataFrame, text_col: str = "text", identity_col: str | None = None, numbered: bool = True) -> DataFrame:
    """``docs`` with ``masked_text``, ``n_masked``, ``minted`` and ``restore_map``. Null text stays null."""
    identity = None if identity_col is None else F.col(identity_col)
    out = with_state(docs, F.coalesce(F.col(text_col), F.lit("")), identity, numbered)
    s = F.col("__state")
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns), F.when(F.col(text_col).isNotNull(), s["text"]).alias("masked_text"), s["n"].alias("n_masked"),
        s["minted"].alias("minted"), minting.restore_map(s["minted"]).alias("restore_map"),
    )


def stub(text: Column) -> Column:
    """The simulated service: the looser patterns, unnumbered."""
    for p in patterns.STUB:
        text = F.regexp_replace(text, p.regex, "{" + p.kind + "}")
    return text


def identity_struct(first: Column, last: Column, school: Column, extra: Column | None = None) -> Column:
    extra = F.array().cast("array<string>") if extra is None else extra
    return F.struct(first.alias("first_name"), last.alias("last_name"), school.alias("school_name"), extra.alias("extra_names"))
