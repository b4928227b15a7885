"""Secret scans (native): a trigram inverted index selects candidates, regular expressions verify them.

1. From each rule's regular expression a Boolean trigram query is derived (:mod:`inkveil.llm.trigrams`): clauses that must
   all hold, each a choice of trigram sets.
2. :func:`postings` is the inverted index of the trigrams that the rules use: rows ``(trigram, key)``, stored in order of
   the trigram within ``PARTS`` parts a list, so that one which a third of all texts are in is no single task's.
3. :func:`candidates` intersects the lists: merged by key, each text has the set of lists it is in, as bits (a partial
   ``bit_or``, so nothing is gathered), and a rule's query is a Boolean expression over them.
4. Candidates are joined back to the texts and verified. Their list is a stored table, so Spark knows its size: below the
   broadcast threshold the texts stay where they are, else the join sorts and the adaptive skew join splits hot keys.

A text's key is a 64-bit hash of the text itself, so no number has to be kept with the rows: copies have one key, and
texts whose hashes collide share their candidates, which costs a needless verification and never loses a match. Rules
without mandatory trigrams (``hex``) scan every text.

Offsets are code points, ends exclusive. Matches of a kind are leftmost and don't overlap; matches that fail the
rule's length are dropped after they have taken their characters. Letters fold in ASCII only.

Defined results. Null text: as empty, no spans, digest of the empty string. Empty table: no rows. Repeated rows: each by
itself. Spans of different kinds may overlap or coincide; all are returned, ordered by start, then by the order of
``RULES``. Other columns are never read by :func:`scan`; :func:`redact` keeps them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm import trigrams
from inkveil.llm.common import let, partitions, stored


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and its least length.
    group: int = 0
    least: int = 1
    base: bool = False


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")

RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, base=True),
    Rule("hex", "[0-9a-f]{16,}", 0, 16, base=True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "(ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36,}"),
    Rule("slack", "(xoxb-|xoxp-|xoxa-|xoxr-|xoxs-)[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "(sk_live_|rk_live_)[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
#: Parts of a trigram's list.
PARTS = 1024
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def satisfied(rule: Rule, has) -> Column:
    """The rule's trigram query; ``has`` says of a trigram whether the text is in its list."""
    clauses = trigrams.query(rule.pattern)
    if not clauses:
        return F.lit(True)
    both = lambda cols: reduce(lambda a, b: a & b, cols)
    some = lambda cols: reduce(lambda a, b: a | b, cols)
    return both([some([both([has(t) for t in sorted(grams)]) for grams in sorted(clause, key=sorted)]) for clause in clauses])


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's spans in one text. Offsets follow from the lengths of the matches and of what lies between."""

    def located(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(x["gaps"], i))
            end = begin + F.length(F.get(x["all"], i))
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            keep = F.length(F.get(x["part"], i)) >= rule.least
            return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["all"]) - 1), start, step, lambda acc: acc["found"])

    pattern = F.lit(rule.pattern)
    every = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else None
    none = F.array().cast(_SPANS)
    return let(
        every,
        lambda m: F.when(F.size(m) == 0, none).otherwise(
            let(F.struct(m.alias("all"), (m if part is None else part).alias("part"), F.split(text, rule.pattern, -1).alias("gaps")), located)
        ),
    )


def _grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams.trigrams(trigrams.query(r.pattern)) for r in rules)))


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index of ``texts(text)``, none null: stored rows ``(trigram, key)``, in order of trigram and key."""
    low = texts.select(_key(F.col("text")).alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in _grams(rules))))
    # The outer form, as the other is preceded by a filter that computes the array once more.
    rows = low.select("key", F.explode_outer(held).alias("trigram")).filter("trigram is not null").select("trigram", "key")
    spread = rows.repartition(partitions(texts.sparkSession), "trigram", F.pmod("key", F.lit(PARTS)))
    return stored(spread.sortWithinPartitions("trigram", "key"), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, rules)``, stored: the texts that satisfy some rule's query, and a bit for each such rule."""
    place = {t: k for k, t in enumerate(_grams(rules))}
    n_words = -(-len(place) // 63)
    slot = F.col("slot")
    slots = index.select("key", F.element_at(F.create_map(*(F.lit(x) for item in place.items() for x in item)), F.col("trigram")).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot % 63)
    merged = slots.groupBy("key").agg(*(F.bit_or(F.when(F.floor(slot / 63) == w, one).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(n_words)))
    has = lambda t: F.col(f"w{place[t] // 63}").bitwiseAND(F.lit(1 << place[t] % 63)) != 0
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(satisfied(r, has), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules) if trigrams.query(r.pattern)))
    return stored(merged.select("key", bits.cast("bigint").alias("rules")).filter("rules <> 0"), "candidates")


def spans_column(text: Column, chosen: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of one text, in order. ``chosen`` has a bit for each rule to verify; those without a query always are."""
    none = F.array().cast(_SPANS)
    found = [F.when(chosen.bitwiseAND(F.lit(1 << k)) != 0, _spans(text, r, k)).otherwise(none) if trigrams.query(r.pattern) else _spans(text, r, k) for k, r in enumerate(rules)]
    return F.sort_array(F.concat(*found))


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``texts(row, text)`` with ``secrets``."""
    if any(trigrams.query(r.pattern) for r in rules):
        chosen = candidates(postings(texts.select("text"), rules), rules).withColumnRenamed("key", "__key")
        keyed = texts.withColumn("__own", _key(F.col("text")))
        texts = keyed.join(chosen, keyed["__own"] == chosen["__key"], "left").select("row", "text", F.coalesce("rules", F.lit(0).cast("bigint")).alias("chosen"))
    else:
        texts = texts.select("row", "text", F.lit(0).cast("bigint").alias("chosen"))
    return texts.select("row", "text", spans_column(F.col("text"), F.col("chosen"), rules).alias("secrets"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.lit([r.kind for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, secrets)``: every span of every text, an array of ``(start, kind, end)`` in order."""
    texts = docs.select(F.col("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return _scanned(texts, rules).select(F.col("row").alias("doc_id"), "secrets")


def compared(docs: DataFrame) -> DataFrame:
    """The columns that the query op1 returns."""
    s = F.col("secrets")
    kinds = [r.kind for r in RULES]
    n = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kinds.index(kind))).cast("bigint")
    n_base = sum(r.base for r in RULES)
    return scan(docs).select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["kind"] < n_base)), 256).alias("base_sha256"), joined(s).alias("spans"),
    )


def redacted(text: Column, spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each span, or each run of overlapping spans, replaced by ``[SECRET:kind]`` of the first."""
    kinds = F.lit([r.kind for r in rules])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("[SECRET:"), F.get(kinds, s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, mark))).alias("out"),
        )

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets cut from ``text``, and ``n_chars``, where there is such a column, counted anew.

    Null texts stay null. All columns stay; the row travels as one struct, so names can't clash.
    """
    x = _scanned(docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text")), rules)
    x = x.select("row", F.when(F.col("row.text").isNotNull(), redacted(F.col("text"), F.col("secrets"), rules)).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return x.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
