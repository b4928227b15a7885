"""Command line: ``python -m inkveil COMMAND``. Each command is a few lines over the library's functions."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import evaluate, tiers
from inkveil.plans import evaluation, redaction
from inkveil.sources import fixtures, gazetteer, readers


def _session() -> SparkSession:
    return SparkSession.builder.appName("inkveil").getOrCreate()


def _keys(spark: SparkSession, path: str | None) -> DataFrame:
    """A gazetteer from an asset file or a Parquet table; the small one of the tests where none is named."""
    if path is None:
        return gazetteer.from_dict(spark, fixtures.SEED)
    return spark.read.parquet(path) if path.endswith(".parquet") else gazetteer.read_text(spark, path)


def frame_cases(spark: SparkSession) -> DataFrame:
    """The labelled sentences as cases; what a frame is put into is empty, so nothing is over-fired on."""
    label = lambda s: F.struct(F.col("frame_id").alias("frame_id"), s["literal"].alias("literal"), s["kind"].alias("kind"), s["keep"].alias("keep"), s["count"].alias("count"), F.col("held_out").alias("held_out"))
    return evaluate.frames(spark).select(F.col("frame_id").alias("essay_id"), "text", F.lit("").alias("base"), F.transform("spans", label).alias("labels"))


def run_eval(args: argparse.Namespace) -> int:
    from inkveil.operators.structured import identity_struct

    spark = _session()
    who = fixtures.IDENTITY
    cases = frame_cases(spark).withColumn("who", identity_struct(*(F.lit(who[c]) for c in ("first_name", "last_name", "school_name"))))
    records = evaluation.run(cases, evaluation.arm(spark, args.arm, _keys(spark, args.gazetteer)), args.arm, "who").cache()
    print(evaluation.report(records))
    missed = records.select(F.explode("spans").alias("s")).filter("not s.passed").count()
    return 1 if args.strict and missed else 0


def run_assets(args: argparse.Namespace) -> int:
    spark = _session()
    if args.what == "show":
        print(json.dumps(gazetteer.describe(spark, args.path), indent=1, sort_keys=True))
        return 0
    manifest = json.loads(spark.read.text(args.path, wholetext=True).first()["value"])
    problems = readers.manifest_problems(spark, manifest, args.path.rpartition("/")[0] or ".")
    print("\n".join(problems) or "all files are as the manifest says")
    return 1 if problems else 0


def run_overfire(args: argparse.Namespace) -> int:
    spark = _session()
    rows = spark.read.parquet(args.feedback)
    essays = spark.read.parquet(args.essays) if args.essays else None
    keys = _keys(spark, args.gazetteer)
    levels = {name: redaction.build(spark, "local", keys, level=name, outbound=name) for name in args.levels.split(",")}
    by_level, by_span = evaluation.over_fire_levels(rows, essays, levels)
    for r in by_level.collect():
        print(f"{r['level']:<20} {r['spans']} spans in {r['documents']} fields of {r['groups']} groups; {r['per_document']:.2f} a field, {r['per_group']:.2f} a group, {r['per_1k']:.3f} in 1,000 characters")
    for r in by_span.orderBy("level", F.desc("n"), "original").limit(args.most).collect():
        print(f"  {r['level']:<18} {r['n']:>5}  {r['original']}")
    return 0


def run_census(args: argparse.Namespace) -> int:
    spark = _session()
    print(evaluation.exposure_report(evaluate.exposure(readers.census_surnames(spark, args.census, args.least), _keys(spark, args.gazetteer))))
    return 0


def run_build(args: argparse.Namespace) -> int:
    """Label tables (``NAME.parquet`` in a folder) to an asset file."""
    spark = _session()
    read = lambda name: spark.read.parquet(f"{args.tables}/{name}.parquet")
    built = tiers.build(*(read(n) for n in ("humans", "places", "titles", "demonyms", "settlements", "census", "births")))
    print(f"{gazetteer.write_text(built, args.out, {'tables': args.tables})} bytes")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkveil")
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        for flag, kw in options:
            sub.add_argument(flag, **kw)
        sub.set_defaults(run=run)

    keys = ("--gazetteer", {})
    command("eval", run_eval, keys, ("--arm", {"default": "local-gazetteer-lowercase"}), ("--strict", {"action": "store_true"}))
    command("assets", run_assets, ("what", {"choices": ["show", "verify"]}), ("path", {}))
    command("overfire", run_overfire, ("feedback", {}), keys, ("--essays", {}), ("--levels", {"default": "identity,gazetteer,gazetteer-lowercase"}), ("--most", {"type": int, "default": 20}))
    command("census", run_census, ("census", {}), keys, ("--least", {"type": int, "default": readers.LEAST_CENSUS}))
    command("build", run_build, ("tables", {}), ("out", {}))
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
