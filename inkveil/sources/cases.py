"""Sentences about the customers of the driver's tables, one a customer and case, for queries over the verdict chain.

A customer's key gives a first and a last name that no list knows, and a tier: of eight customers one is in no tier, one
is a full name, and so on. What becomes of a sentence follows from its case and the customer's tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By key modulo eight: nothing, or the tier and whether the key is the whole name, the first or the last.
TIERS = (None, ("full", "both"), ("short", "last"), ("place", "both"), ("title", "both"), ("demonym", "last"), ("settlement", "both"), ("given", "first"))

#: Case, and its text with ``{F}`` and ``{L}`` for the names.
TEXTS = {
    "plain": "Then we met {F} {L} at noon.",
    "relation_before": "Then my cousin {F} {L} came by.",
    "relation_after": "Then {F} {L}, who is my uncle, came by.",
    "surname_again": "We read {F} {L} today. Then {L} spoke.",
    "surname_in_own_life": "We read {F} {L} today. Then my neighbor {L} spoke.",
    "opening": "{F} left early.",
    "opening_with_evidence": "{L} left early. Nobody saw {L} again.",
    "organisation": "We sued {F} {L} Bank again.",
    "landmark": "We saw {F} {L} Museum again.",
    "possessive": "We took {F} {L}'s car.",
    "in_braces": "We met {{L}} and @PERSON1 there.",
    "heading": "\n\n{F} {L}\n\nThen it rained all day.",
    "honorific": "We met Mrs. {L} there.",
    "over_lines": "We met {F}\n{L} there.",
    "lower_case": "then i met {f} {l} again",
    "stop_words": "We asked The {L} And {F} {L} about it.",
}


def _letters(key: Column) -> Column:
    return F.translate(key.cast("string"), "0123456789", "aeioubcdfg")


def people(customers: DataFrame) -> DataFrame:
    """``(c_custkey, first, last, tier_no)``."""
    key = F.col("c_custkey")
    return customers.select(key, F.concat(F.lit("Zor"), _letters(key)).alias("first"), F.concat(F.lit("Quin"), _letters(key)).alias("last"), F.pmod(key, F.lit(8)).cast("int").alias("tier_no"))


def gazetteer(customers: DataFrame) -> DataFrame:
    """``(tier, key)``."""
    names = {"both": F.lower(F.concat_ws(" ", "first", "last")), "first": F.lower("first"), "last": F.lower("last")}
    entries = [F.when(F.col("tier_no") == k, F.struct(F.lit(t[0]).alias("tier"), names[t[1]].alias("key"))) for k, t in enumerate(TIERS) if t]
    return people(customers).select(F.coalesce(*entries).alias("e")).filter("e is not null").select("e.tier", "e.key")


def filled(text: str) -> Column:
    """A text with the names of the row put in."""
    out = F.lit(text)
    for mark, name in (("{F}", F.col("first")), ("{L}", F.col("last")), ("{f}", F.lower("first")), ("{l}", F.lower("last"))):
        out = F.replace(out, F.lit(mark), name)
    return out


def documents(customers: DataFrame, case: str) -> DataFrame:
    """``(c_custkey, first, last, tier_no, text)``."""
    return people(customers).select("*", filled(TEXTS[case]).alias("text"))
