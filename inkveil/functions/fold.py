"""Folding of names to gazetteer keys: exact in Python, and as columns for Latin scripts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTES = {0x2018: "'", 0x2019: "'", 0x02BC: "'", 0x2032: "'", 0x201C: '"', 0x201D: '"'}
_DASHES = dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212), "-")
_PLAIN = _QUOTES | _DASHES


def fold(name: str) -> str:
    """The key of a name: plain quotes and dashes, no accents, lower case, letters and digits with ``'`` and ``-`` only,
    single spaces, one possessive tail less."""
    return name.lower() if name.isascii() and name.isalpha() else _fold(name)


@lru_cache(1 << 16)
def _fold(name: str) -> str:
    decomposed = unicodedata.normalize("NFKD", name.translate(_PLAIN))
    letters = "".join(c for c in decomposed if not unicodedata.combining(c)).lower()
    key = " ".join("".join(c if c in "'-" or c.isalnum() else " " for c in letters).split())
    for tail in ("'s", "s'"):
        if key.endswith(tail) and len(key) > len(tail) + 1:
            return key.removesuffix(tail).rstrip("'").strip()
    return key


def _latin() -> tuple[str, str]:
    """Single letters of the Latin blocks whose decomposition is one ASCII letter and marks."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def fold_column(name: Column) -> Column:
    """The same as columns, for names in Latin letters up to U+024F: no function of Spark decomposes other scripts."""
    return _without_tail(_spaced(name))


def fold_each(names: Column) -> Column:
    """:func:`fold_column` of each name of an array, in two steps so that no name is cleaned more than once."""
    return F.transform(F.transform(names, _spaced), _without_tail)


def _spaced(name: Column) -> Column:
    source, target = _latin()
    quotes = "".join(map(chr, _PLAIN))
    plain = F.translate(name, quotes + source, "".join(_PLAIN.values()) + target)
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(plain, "\\p{Mn}", "")), "[^\\p{L}\\p{N}'-]+", " "))


def _without_tail(spaced: Column) -> Column:
    bare = lambda tail: F.trim(F.rtrim(F.substring(spaced, F.lit(1), F.length(spaced) - len(tail)), F.lit("'")))
    has = lambda tail: spaced.endswith(tail) & (F.length(spaced) > len(tail) + 1)
    return F.when(has("'s"), bare("'s")).when(has("s'"), bare("s'")).otherwise(spaced)
