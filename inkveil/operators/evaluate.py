"""Measuring redaction: injection into essays, scores, invariants, tallies, exposure, over-firing, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions.columns import let, located
from inkveil.functions.lexicon import ABBREVIATIONS
from inkveil.sources.fixtures import FRAMES, Frame

KINDS = (
    "NAME SCHOOL ORGANIZATION LOCATION EMAIL URL US_SOCIAL_SECURITY_NUMBER IP_ADDRESS PHONE ADDRESS DATE_OF_BIRTH USERNAME CREDIT_DEBIT_CARD_NUMBER ZIP_CODE AGE"
).split()
PLACEHOLDER = "\\{([A-Z_]+?)(?:_\\d+)?\\}"


def frames(spark: SparkSession, source: tuple[Frame, ...] = FRAMES) -> DataFrame:
    rows = [(f.frame_id, f.group, f.sentence, f.held_out, [(s.literal, s.kind, s.keep, s.count) for s in f.spans]) for f in source]
    return spark.createDataFrame(rows, "frame_id string, grp string, text string, held_out boolean, spans array<struct<literal:string,kind:string,keep:boolean,count:int>>")


def occurrences(text: Column, literal: Column) -> Column:
    """Non-overlapping occurrences of a literal that isn't empty."""
    return ((F.length(text) - F.length(F.replace(text, literal, F.lit("")))) / F.length(literal)).cast("int")


def span_passed(masked: Column, span: Column) -> Column:
    n = occurrences(masked, span["literal"])
    return F.when(span["count"].isNotNull(), n == span["count"]).when(span["keep"], n > 0).otherwise(n == 0)


def score(masked: DataFrame) -> DataFrame:
    """``(frame_id, grp, held_out, kind, verdict, literal, passed)``: a row a labelled span, from frames with ``masked_text``."""
    rows = masked.select("frame_id", "grp", "held_out", "masked_text", F.explode("labels").alias("s"))
    return rows.select(
        "frame_id", "grp", "held_out", F.col("s.kind").alias("kind"), F.when(F.col("s.keep"), "keep").otherwise("redact").alias("verdict"), F.col("s.literal").alias("literal"),
        span_passed(F.col("masked_text"), F.col("s")).alias("passed"),
    )


def tally(scored: DataFrame) -> DataFrame:
    """Passed and total by split, by verdict, by frame and over all, in one pass: grouping sets."""
    scored.createOrReplaceTempView("inkveil_scored")
    return scored.sparkSession.sql(
        "SELECT held_out, verdict, frame_id, sum(int(passed)) AS passed, count(*) AS total FROM inkveil_scored "
        "GROUP BY GROUPING SETS ((held_out, verdict), (verdict), (frame_id), ())"
    )


def align(masked: Column, text: Column) -> Column:
    """``struct(ok, reason, regions)``: which region of the original each placeholder stands for, found anew from the prose
    that survived. An independent witness to what was minted."""
    marks = F.regexp_extract_all(masked, F.lit(PLACEHOLDER), F.lit(0))
    prose = F.split(masked, PLACEHOLDER, -1)
    quoted = F.transform(prose, lambda p: F.regexp_replace(p, "([^\\p{L}\\p{N}\\s])", "\\\\$1"))
    rx = F.concat(F.lit("(?s)\\A"), F.array_join(quoted, "(.+?)"), F.lit("\\z"))
    ok = F.rlike(text, rx)
    regions = F.when(ok & (F.size(marks) > 0), F.transform(F.sequence(F.lit(1), F.size(marks)), lambda i: F.call_function("regexp_extract", text, rx, i)))
    return F.struct(ok.alias("ok"), F.when(~ok, "prose does not survive").alias("reason"), F.coalesce(regions, F.array().cast("array<string>")).alias("regions"))


def violations(masked: Column, text: Column, restored: Column, labels: Column) -> Column:
    """What is wrong with one result, as ``array<struct(kind, detail)>``."""
    entry = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    unknown = F.filter(F.array_distinct(F.regexp_extract_all(masked, F.lit(PLACEHOLDER), F.lit(1))), lambda k: ~k.isin(KINDS))
    secret = F.filter(labels, lambda s: ~s["keep"] & s["count"].isNull())
    whole = F.filter(secret, lambda s: occurrences(masked, s["literal"]) > 0)
    words = lambda s: F.filter(F.regexp_extract_all(s["literal"], F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    partial = F.filter(secret, lambda s: (occurrences(masked, s["literal"]) == 0) & F.exists(words(s), lambda w: F.rlike(masked, F.concat(F.lit("\\b"), w, F.lit("\\b")))))
    lost = F.filter(labels, lambda s: s["keep"] & (occurrences(masked, s["literal"]) == 0))
    none = F.array().cast("array<struct<kind:string,detail:string>>")
    parts = [
        F.transform(unknown, lambda k: entry("unknown-placeholder", k)), F.transform(whole, lambda s: entry("leak", s["literal"])),
        F.transform(partial, lambda s: entry("partial-leak", s["literal"])), F.transform(lost, lambda s: entry("keep-destroyed", s["literal"])),
        F.when(~align(masked, text)["ok"], F.array(entry("chunk-alignment", F.lit("")))).otherwise(none),
        F.when(restored != text, F.array(entry("not-restorable", F.lit("")))).otherwise(none),
    ]
    return F.concat(*parts)


def wrong_type(regions: DataFrame) -> DataFrame:
    """``regions(frame_id, token_kind, region, labels)`` whose label expects another kind."""
    hit = F.filter("labels", lambda s: ~s["keep"] & F.contains(F.col("region"), s["literal"]))
    return regions.filter((F.size(hit) > 0) & ~F.exists(hit, lambda s: s["kind"] == F.col("token_kind")))


def kind_census(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(kind, n, docs)`` of placeholders in masked texts."""
    rows = masked.select(F.col(id_col).alias("d"), F.explode(F.regexp_extract_all("masked_text", F.lit(PLACEHOLDER), F.lit(1))).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("d").alias("docs"))


def injection_points(text: Column) -> Column:
    """Offsets at which a sentence can be put in: after an end of sentence and its space, not after an initial or a title's
    abbreviation."""
    ends = located(text, "[.!?][\"'”’)]*\\s+")
    short = f"(?i)(?:^|[^A-Za-z])(?:[A-Z]|{'|'.join(sorted(ABBREVIATIONS))})$"
    fine = F.filter(ends, lambda e: (e["end"] < F.length(text)) & ~F.substring(text, F.greatest(F.lit(1), e["start"] - 12), F.least(F.lit(13), e["start"])).rlike(short))
    return F.transform(fine, lambda e: e["end"])


def inject(essays: DataFrame, plan: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(essay_id, text, base, frames, slots)``: each plan row's sentences put into its essay, last slot first.

    ``plan(essay_id, base_sha256, frames, slots)``; a missing essay or another digest raises.
    """
    both = plan.join(essays.select("essay_id", F.col("text").alias("base")), "essay_id", "left")
    bad = F.col("base").isNull() | (F.sha2("base", 256) != F.col("base_sha256"))
    both = both.withColumn("base", F.when(bad, F.raise_error(F.concat(F.lit("essay differs from the plan: "), F.col("essay_id").cast("string")))).otherwise(F.col("base")))
    rows = both.select("essay_id", F.posexplode(F.arrays_zip("frames", "slots")).alias("i", "x")).select("essay_id", F.col("x.frames").alias("frame_id"), F.col("x.slots").alias("slot"))
    put = rows.join(sentences.select("frame_id", F.col("text").alias("sentence")), "frame_id")
    lists = put.groupBy("essay_id").agg(F.sort_array(F.collect_list(F.struct("slot", "frame_id", "sentence")), asc=False).alias("put"))
    splice = lambda t, p: F.concat(F.substring(t, F.lit(1), p["slot"]), p["sentence"], F.lit(" "), F.substring(t, p["slot"] + 1, F.length(t)))
    return both.join(lists, "essay_id").select("essay_id", F.aggregate("put", F.col("base"), splice).alias("text"), "base", "frames", "slots")


def unaccounted(essays: DataFrame, plan: DataFrame, unusable: DataFrame) -> DataFrame:
    """Essays that neither the plan nor the list of unusable ones names."""
    return essays.join(plan.select("essay_id"), "essay_id", "left_anti").join(unusable.select("essay_id"), "essay_id", "left_anti").select("essay_id")


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, n, p50, p95, most)``; the 95th is the element at ``int(n * 0.95)`` of the sorted values.

    Equal values are counted first, so an arm is ordered by its distinct values, and none is gathered in a row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    arm = Window.partitionBy(by)
    upto = F.sum("c").over(arm.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(by, "v", "c", upto.alias("upto"), F.sum("c").over(arm).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v")))
    return placed.groupBy(by).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("most"))


def regression_percent(previous: Column, current: Column) -> Column:
    return (F.median(current) / F.median(previous) - 1) * 100


def exposure(census: DataFrame, gazetteer: DataFrame, tiers: tuple[str, ...] = ("short", "place", "demonym")) -> DataFrame:
    """``(tier, bearers, exposed_bearers, names, exposed_names)`` of surnames kept in the clear, by tier and (null) over all."""
    single = gazetteer.filter(F.col("tier").isin(*tiers) & ~F.col("key").contains(" ")).select(F.col("key").alias("name"), "tier").distinct()
    total = census.agg(F.coalesce(F.sum("bearers"), F.lit(0)).alias("bearers"), F.count("*").alias("names")).first()
    hit = census.join(single, "name")
    by = hit.groupBy("tier").agg(F.sum("bearers").alias("exposed_bearers"), F.count("*").alias("exposed_names"))
    every = hit.select("name", "bearers").distinct().agg(F.lit(None).cast("string").alias("tier"), F.coalesce(F.sum("bearers"), F.lit(0)).alias("exposed_bearers"), F.count("*").alias("exposed_names"))
    cols = F.lit(total["bearers"]).alias("bearers"), "exposed_bearers", F.lit(total["names"]).alias("names"), "exposed_names"
    return by.unionByName(every).select("tier", *cols)


def over_fire(masked: DataFrame, by: str, id_col: str = "doc_id") -> DataFrame:
    """Over texts that name nobody, every mask is one too many: ``(by, docs, docs_touched, spans, chars, per_doc, per_1k)``."""
    rows = masked.select(by, "n_masked", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    out = rows.groupBy(by).agg(
        F.count("*").alias("docs"), F.sum((F.col("n_masked") > 0).cast("bigint")).alias("docs_touched"), F.sum("n_masked").alias("spans"), F.sum("chars").alias("chars")
    )
    return out.withColumn("per_doc", F.col("spans") / F.col("docs")).withColumn("per_1k", F.when(F.col("chars") > 0, F.col("spans") * 1000 / F.col("chars")))


def billed_units(texts: DataFrame, by: str, text_col: str = "text", simulated: bool = False) -> DataFrame:
    """``(by, calls, units)``: each call is rounded up to thousands of characters."""
    units = F.lit(0).cast("bigint") if simulated else F.ceil(F.length(F.coalesce(text_col, F.lit(""))) / 1000)
    return texts.groupBy(by).agg(F.count("*").alias("calls"), F.sum(units).alias("units"))


def figures(people: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(domain, n, full_kept, surname_kept)`` of ``people(full_name, surname, domain)``: keys looked up in the keep tiers."""
    tiers = gazetteer.filter("tier in ('full', 'short', 'place', 'title', 'demonym')").select("key").distinct()
    f = people.join(tiers.select(F.col("key").alias("full_name"), F.lit(1).alias("f")), "full_name", "left")
    s = f.join(tiers.select(F.col("key").alias("surname"), F.lit(1).alias("s")), "surname", "left")
    return s.groupBy("domain").agg(F.count("*").alias("n"), F.avg(F.coalesce("f", F.lit(0))).alias("full_kept"), F.avg(F.coalesce("s", F.lit(0))).alias("surname_kept"))


GATES = (
    ("held_out_recall", ">=", 100.0, None), ("held_out_recall_carrier", ">=", 100.0, "corpus"), ("keep_precision", ">=", 100.0, None), ("round_trip", ">=", 100.0, None),
    ("unaccounted_violations", "==", 0.0, None), ("over_fire_prose", "<=", 0.61, "corpus"), ("bare_surname_exposure", "<=", 1.25, "census"),
    ("latency_regression", "<=", 8.0, "pair"), ("asset_entries", ">=", 1.0, None),
)


def gates(spark: SparkSession, measured: DataFrame, have: set[str]) -> DataFrame:
    """``(gate, op, bar, value, verdict)``; ``measured(gate, value)``. A gate without its input or its value is
    NOT_MEASURED, never passed."""
    rows = spark.createDataFrame([(g, o, b, r is None or r in have) for g, o, b, r in GATES], "gate string, op string, bar double, can boolean")
    v = F.col("value")
    good = F.when(F.col("op") == ">=", v >= F.col("bar")).when(F.col("op") == "<=", v <= F.col("bar")).otherwise(v == F.col("bar"))
    out = rows.join(measured, "gate", "left")
    value = F.when(F.col("can"), v)
    return out.select("gate", "op", "bar", value.alias("value"), F.when(~F.col("can") | v.isNull(), "NOT_MEASURED").when(good, "PASS").otherwise("FAIL").alias("verdict"))


def band(docs: DataFrame, low: int, high: int, n: int, id_col: str = "doc_id") -> DataFrame:
    """The first ``n`` documents by id of a length band, line ends made ``\\n``, with their digests."""
    clean = F.regexp_replace("text", "\r\n", "\n")
    rows = docs.select(id_col, clean.alias("text")).filter(F.length("text").between(low, high)).orderBy(id_col).limit(n)
    return rows.select(id_col, F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def restored(masked: Column, mapping: Column) -> Column:
    """A text with its restore map applied, longest placeholder first."""
    entries = F.array_sort(F.map_entries(mapping), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return let(entries, lambda es: F.aggregate(es, masked, lambda acc, e: F.replace(acc, e["key"], e["value"])))
