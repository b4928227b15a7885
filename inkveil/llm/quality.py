"""Quality rules (native): base counts, and distribution divergence against language references.

A text is compared with each language's reference by the Jensen-Shannon distance (base 2, so 0 to 1) of two
histograms: its character classes, and its common words. The nearest language counts. Texts under the length
guards skip the comparison, since short histograms diverge by chance. All of it is column expressions over one
row: the plan is a scan and a projection, with no shuffle, whatever the size of the corpus.

Defined results. Null text: as empty, so no words, ``base_failed`` true. Empty text: the same. A text without
line feeds is one line. Repeated rows: each is judged by itself. Null doc_id: passed through. Other columns of
the input are never read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import WS, WS_CHARS, let

#: Rules of the base.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
#: Length guards of the two comparisons, in words.
GUARD_CHARS, GUARD_WORDS = 50, 100
#: Distances from which a text is rejected. Prose of the four languages lies below both; the second is what a text
#: almost without function words of any of them comes to.
MOST_CHARS, MOST_WORDS = 0.40, 0.35

#: Shares of upper-case letters, digits, punctuation, symbols, white space and the rest in plain prose.
CHAR_REFERENCE = {
    "en": (0.025, 0.002, 0.025, 0.001, 0.160, 0.787),
    "fr": (0.025, 0.002, 0.028, 0.001, 0.160, 0.784),
    "de": (0.050, 0.002, 0.028, 0.001, 0.145, 0.774),
    "es": (0.025, 0.002, 0.026, 0.001, 0.165, 0.781),
}
#: Shares of frequent function words among all words, in thousandths.
WORD_REFERENCE = {
    "en": {"the": 55, "of": 30, "and": 28, "to": 25, "a": 22, "in": 20, "is": 11, "that": 10, "it": 10, "was": 9, "for": 9, "on": 7, "as": 7, "with": 7, "he": 7, "by": 6, "be": 6, "at": 5, "this": 5, "from": 4},
    "fr": {"de": 50, "la": 30, "le": 25, "et": 22, "les": 20, "des": 18, "en": 15, "un": 12, "du": 12, "une": 10, "que": 10, "est": 9, "dans": 9, "qui": 9, "pour": 8, "au": 6, "par": 6, "sur": 6, "avec": 4, "ou": 4},
    "de": {"der": 32, "die": 32, "und": 28, "in": 18, "den": 12, "von": 11, "zu": 11, "das": 11, "mit": 9, "sich": 8, "ist": 8, "des": 8, "im": 7, "dem": 7, "auf": 7, "nicht": 7, "ein": 7, "eine": 7, "als": 6, "es": 5},
    "es": {"de": 60, "la": 38, "que": 30, "el": 28, "en": 26, "y": 26, "los": 16, "a": 16, "se": 12, "del": 12, "las": 10, "un": 10, "por": 9, "con": 9, "no": 8, "una": 8, "su": 7, "para": 7, "es": 7, "al": 6},
}
def word_array(text: Column) -> Column:
    """The words ``[^white space]+`` of a text that isn't null."""
    trimmed = F.trim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+", -1))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of ``WINDOW`` words that the text has twice or more.

    Windows are told apart by a 64-bit hash over their words' 64-bit hashes. Only a text that has equal windows pays
    for the sort that finds their positions.
    """
    hashes = F.when(
        F.size(words) >= WINDOW,
        let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda each: F.transform(
                F.sequence(F.lit(0), F.size(each) - WINDOW), lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(WINDOW)))
            ),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i"))))

        def positions(z: Column) -> Column:
            last = F.size(z) - 1
            return F.sort_array(
                F.transform(
                    F.filter(z, lambda e, i: ((i > 0) & (F.get(z, i - 1)["h"] == e["h"])) | ((i < last) & (F.get(z, i + 1)["h"] == e["h"]))),
                    lambda e: e["i"],
                )
            )

        start = F.struct(F.lit(-WINDOW).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW).cast("bigint"), x - acc["last"])).alias("n"))
        return F.aggregate(let(ranked, positions), start, step, lambda acc: acc["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms: arrays as long as each other, each summing to 1."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(shares, reference, term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def char_distance(shares: Column) -> Column:
    """To the nearest language."""
    return F.least(*(js_distance(shares, F.lit([x / sum(ref) for x in ref])) for ref in CHAR_REFERENCE.values()))


def word_distance(common: Column, n: Column) -> Column:
    """To the language that lists most of the text's words (of equals the first).

    ``common`` are the text's words that any reference lists, in lower case; ``n`` counts all its words.
    """
    lists = F.lit([list(ref) for ref in WORD_REFERENCE.values()])
    references = F.lit([[x / 1000 for x in ref.values()] + [1 - sum(ref.values()) / 1000] for ref in WORD_REFERENCE.values()])
    held_by = lambda ref: F.size(F.filter(common, lambda w: w.isin(list(ref))))
    listed = F.array(*map(held_by, WORD_REFERENCE.values()))

    def of(language: Column) -> Column:
        held = F.transform(F.get(lists, language), lambda w: (F.size(common) - F.size(F.array_remove(common, w))) / n)
        rest = lambda h: F.array_append(h, F.greatest(F.lit(0.0), 1 - F.aggregate(h, F.lit(0.0), lambda a, x: a + x)))
        return js_distance(let(held, rest), F.get(references, language))

    return let(let(listed, lambda x: F.array_position(x, F.array_max(x)).cast("int") - 1), of)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the base counts, the two distances (null under their guards) and the verdict."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    forms = sorted({f for ref in WORD_REFERENCE.values() for w in ref for f in (w, w.capitalize())})
    counted = base.select("doc_id", "text", word_array(F.col("text")).alias("words")).select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("\\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit("[.,;:!?'\"()-]")).alias("n_punct"),
        let(
            F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{WS}]")),
            lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        ).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform(F.filter("words", lambda w: w.isin(forms)), F.lower).alias("common"),
    )
    n = F.col("n_words")
    chars = [F.col(c) / F.col("n_chars") for c in ("n_upper", "n_digits", "n_punct", "n_symbols")]
    space = (F.col("n_chars") - F.col("word_chars")) / F.col("n_chars")
    rest = F.greatest(F.lit(0.0), 1 - (chars[0] + chars[1] + chars[2] + chars[3] + space))
    failed = (n < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED_PERCENT) * n)
    judged = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(n >= GUARD_CHARS, char_distance(F.array(*chars, space, rest))).alias("js_chars"),
        F.when(n >= GUARD_WORDS, word_distance(F.col("common"), n)).alias("js_words"),
    )
    diverges = (F.coalesce(F.col("js_chars"), F.lit(0.0)) > MOST_CHARS) | (F.coalesce(F.col("js_words"), F.lit(0.0)) > MOST_WORDS)
    return judged.withColumn("kept", ~F.col("base_failed") & ~diverges)


def kept(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The verdict is computed beside a struct of the whole row, so no column name of the input can clash.
    """
    packed = docs.select(F.struct("*").alias("row"))
    names = docs.columns
    out = measure(packed.select(F.col("row").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text")))
    # A filter moves below projections, and would compute each column it needs anew wherever the verdict uses it. It
    # doesn't move below one with a column that isn't deterministic, so every row is measured once.
    once = out.select("doc_id", "kept", F.monotonically_increasing_id().alias("once"))
    return once.filter(F.col("kept") & (F.col("once") >= 0)).select(*(F.col(f"doc_id.`{c}`").alias(c) for c in names))


def compared(docs: DataFrame) -> DataFrame:
    """The columns that the query op10 returns."""
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
