"""Evaluation runs: arms, records a case, summaries, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import evaluate
from inkveil.operators.names import Options
from inkveil.plans import config, redaction

#: Level of each arm that runs here. ``local-candidates`` has an oracle that knows nobody, so it shows what generation alone does.
ARMS: dict[str, str] = {
    "local": config.IDENTITY, "local-candidates": config.GAZETTEER, "local-gazetteer": config.GAZETTEER, "local-gazetteer-lowercase": config.LOWERCASE,
    "path-identity": config.IDENTITY, "path-gazetteer": config.GAZETTEER, "path-gazetteer-lowercase": config.LOWERCASE,
}
LABELS = "array<struct<frame_id:string,literal:string,kind:string,keep:boolean,count:int,held_out:boolean>>"


class UnknownArm(ValueError):
    pass


def arm(spark: SparkSession, name: str, gazetteer: DataFrame | None = None, options: Options | None = None, client: Callable[[], redaction.Service] | None = None) -> redaction.Redactor:
    """The redactor of an arm. ``path-*`` arms take no ``options``, as a host can't set them either."""
    if name == "stub":
        return redaction.build(spark, config.STUB)
    if name == "guardrail":
        return redaction.build(spark, config.SERVICE, client=client)
    if name not in ARMS:
        raise UnknownArm(f"{name!r}; known: {', '.join([*ARMS, 'stub', 'guardrail'])}")
    if name == "local-candidates":
        gazetteer = spark.createDataFrame([], "tier string, key string")
    return redaction.build(spark, config.LOCAL, gazetteer, level=ARMS[name], options=None if name.startswith("path-") else options)


def suffixed(name: str, options: Options) -> str:
    """An arm's name with what its options leave out."""
    off = {"corroborate": "nocorr", "numbered": "nonum", "headings": "nohead", "relation_refusal": "norel", "title_relation_refusal": "notitle"}
    return "-".join([name, *(s for field, s in off.items() if not getattr(options, field))])


def run(cases: DataFrame, redactor: redaction.Redactor, mode: str, identity_col: str | None = None) -> DataFrame:
    """A record a case. ``cases(essay_id, text, base, labels)``: the text with its frames put in, the text without, and what is
    expected of the frames' literals.

    Both texts are masked in one pass over rows that say which of them they are, then meet again by case; each case is
    two rows, so no group grows.
    """
    keep = ["essay_id", "labels", *([identity_col] if identity_col else [])]
    sides = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("t")), F.struct(F.lit(False).alias("whole"), F.col("base").alias("t"))))
    rows = cases.select(*keep, sides.alias("side")).select(*keep, "side.whole", F.col("side.t").alias("t"))
    masked = redactor.redact_inbound(rows, "t", identity_col)
    back = F.coalesce(evaluate.restored(F.col("masked_text"), F.col("restore_map")), F.col("t"))
    regions = evaluate.align(F.col("masked_text"), F.col("t"))["regions"]
    rewrites = F.filter(regions, lambda r: r.rlike("^@[A-Z]+\\d*$"))
    prose = F.filter(regions, lambda r: ~r.rlike("^@[A-Z]+\\d*$"))
    whole, base = masked.filter("whole"), masked.filter("not whole")
    passed = F.transform("labels", lambda s: F.struct(s["frame_id"].alias("frame_id"), s["kind"].alias("kind"), F.when(s["keep"], "keep").otherwise("redact").alias("verdict"), s["literal"].alias("literal"), s["held_out"].alias("held_out"), evaluate.span_passed(F.col("masked_text"), s).alias("passed")))
    plain = F.transform("labels", lambda s: F.struct(s["literal"].alias("literal"), s["kind"].alias("kind"), s["keep"].alias("keep"), s["count"].alias("count")))
    scored = whole.select(
        "essay_id", passed.alias("spans"), evaluate.violations(F.col("masked_text"), F.col("t"), back, plain).alias("violations"), (back == F.col("t")).alias("round_trips"),
        F.ceil(F.length("t") / 1000).cast("int").alias("char_units"), "intervened",
    )
    chars = F.aggregate(prose, F.lit(0), lambda acc, r: acc + F.length(r))
    over = base.select("essay_id", F.size(prose).alias("base_fp_spans"), chars.alias("base_fp_chars"), F.size(rewrites).alias("base_rewrites"))
    n = lambda verdict, ok: F.size(F.filter("spans", lambda s: (s["verdict"] == verdict) & (s["passed"] | F.lit(not ok))))
    return scored.join(over, "essay_id").select(
        "essay_id", F.lit(mode).alias("mode"), F.array_distinct(F.transform("spans", lambda s: s["frame_id"])).alias("frames"), "spans", n("redact", False).alias("n_redact"), n("keep", False).alias("n_keep"),
        n("redact", True).alias("recalled"), n("keep", True).alias("kept"), "violations", "round_trips", "base_fp_spans", "base_fp_chars", "base_rewrites", "char_units", "intervened",
    )


def summarize(records: DataFrame) -> DataFrame:
    """A row a mode: recall and precision in percent, over all, visible and held-out spans (null where there are none),
    round trips, over-firing and billed units a case."""
    spans = records.select("mode", F.explode("spans").alias("s")).select("mode", "s.verdict", F.col("s.held_out").alias("held"), F.col("s.passed").cast("int").alias("ok"))

    def percent(verdict: str, held: bool | None) -> Column:
        mine = F.col("verdict") == verdict
        return F.avg(F.when(mine if held is None else mine & (F.col("held") == held), F.col("ok"))) * 100

    rates = spans.groupBy("mode").agg(*(
        percent(v, h).alias(f"{name}_{split}") for name, v in (("recall", "redact"), ("precision", "keep")) for split, h in (("all", None), ("visible", False), ("held_out", True))
    ))
    per_case = records.groupBy("mode").agg(
        F.count("*").alias("cases"), F.sum("n_redact").alias("recall_spans"), F.sum("n_keep").alias("precision_spans"), (F.avg(F.col("round_trips").cast("int")) * 100).alias("round_trip_rate"),
        F.sum(F.size("violations")).alias("violations"), F.avg("char_units").alias("units_mean"), F.avg("base_fp_spans").alias("over_fire_spans"), F.avg("base_fp_chars").alias("over_fire_chars"),
        F.avg("base_rewrites").alias("rewrites"),
    )
    return per_case.join(rates, "mode", "left")


def by_frame(records: DataFrame) -> DataFrame:
    """``(mode, frame, passed, total)``, a frame being its id and verdict: misses first, then by name."""
    spans = records.select("mode", F.explode("spans").alias("s"))
    frame = F.concat(F.col("s.frame_id"), F.lit(" ["), F.col("s.verdict"), F.lit("]"))
    out = spans.groupBy("mode", frame.alias("frame")).agg(F.sum(F.col("s.passed").cast("int")).alias("passed"), F.count("*").alias("total"))
    return out.orderBy("mode", F.col("passed") / F.col("total"), "frame")


def by_kind(records: DataFrame) -> DataFrame:
    """``(mode, kind, n)`` of violations, most frequent first."""
    return records.select("mode", F.explode("violations.kind").alias("kind")).groupBy("mode", "kind").agg(F.count("*").alias("n")).orderBy("mode", F.desc("n"), "kind")


def _percent(value: float | None) -> str:
    return "-" if value is None else f"{value:.1f}%"


def report(records: DataFrame) -> str:
    """The figures of each mode as text; frames with misses come first."""
    lines = []
    kinds, frames = by_kind(records).collect(), by_frame(records).collect()
    for r in summarize(records).orderBy("mode").collect():
        lines += [f"== {r['mode']} ({r['cases']} cases)"]
        for name in ("recall", "precision"):
            lines.append(f"{name:<10} all {_percent(r[f'{name}_all'])}, visible {_percent(r[f'{name}_visible'])}, held out {_percent(r[f'{name}_held_out'])} ({r[f'{name}_spans']} spans)")
        lines.append(f"round trips {_percent(r['round_trip_rate'])}; over-fire {r['over_fire_spans']:.2f} spans, {r['over_fire_chars']:.0f} characters a case; {r['units_mean']:.2f} units a case")
        lines += [f"  violation {k['kind']}: {k['n']}" for k in kinds if k["mode"] == r["mode"]]
        lines += [f"  {f['frame']}: {f['passed']}/{f['total']}" for f in frames if f["mode"] == r["mode"]]
    return "\n".join(lines)


def exposure_report(exposed: DataFrame) -> str:
    """What share of surname bearers a bare surname leaves in the clear, by tier and over all."""
    rows = sorted(exposed.collect(), key=lambda r: (r["tier"] is not None, r["tier"] or ""))
    share = lambda a, b: f"{100 * a / b if b else 0:.2f}%"
    return "\n".join(f"{r['tier'] or 'any tier':<10} {share(r['exposed_bearers'], r['bearers'])} of {r['bearers']:,} bearers, {share(r['exposed_names'], r['names'])} of {r['names']:,} surnames" for r in rows)


def over_fire_levels(feedback: DataFrame, essays: DataFrame | None, redactors: dict[str, redaction.Redactor], group: str = "group_id", order: str = "field_no") -> tuple[DataFrame, DataFrame]:
    """What each level masks in texts that name nobody: ``(level, documents, groups, characters, spans, documents_touched,
    per_document, per_group, per_1k)``, and ``(level, original, n)``.

    A group's fields are masked as one text, with the keeps of its essay carried over. Groups and essays must match
    one to one; else this raises, as another essay's names would be carried.
    """
    if essays is not None:
        both = feedback.select(group).distinct().join(essays.groupBy(group).agg(F.count("*").alias("n")), group, "full_outer")
        bad = both.filter("n is null or n <> 1").count() + essays.select(group).distinct().join(feedback.select(group).distinct(), group, "left_anti").count()
        if bad:
            raise ValueError(f"{bad} groups have no essay of their own, or the other way round")
    text = F.coalesce("text", F.lit(""))
    size = feedback.agg(F.count("*").alias("documents"), F.count_distinct(group).alias("groups"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))
    filled = feedback.filter(F.length(text) > 0).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda f: f["t"]), redaction.SEPARATOR).alias("text"))
    levels, spans = None, None
    for name, r in redactors.items():
        out = r.redact_inbound(filled) if essays is None else r.redact_outbound(filled, essays, on=group)
        masked = out.select(F.map_values("restore_map").alias("found"), F.size(F.filter(F.split("masked_text", redaction.SEPARATOR, -1), lambda p: p.contains("{"))).alias("parts"))
        touched = masked.agg(F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("spans"), F.coalesce(F.sum(F.when(F.size("found") > 0, F.col("parts")).otherwise(0)), F.lit(0)).alias("documents_touched"))
        rate = lambda by: F.when(F.col(by) > 0, F.col("spans") / F.col(by)).otherwise(0.0)
        row = size.crossJoin(touched).select(  # a row each
            F.lit(name).alias("level"), "documents", "groups", "characters", "spans", "documents_touched", rate("documents").alias("per_document"), rate("groups").alias("per_group"), (rate("characters") * 1000).alias("per_1k"),
        )
        each = masked.select(F.lit(name).alias("level"), F.explode("found").alias("original")).groupBy("level", "original").agg(F.count("*").alias("n"))
        levels, spans = (row, each) if levels is None else (levels.unionByName(row), spans.unionByName(each))
    return levels, spans
