"""Readers of corpora, registers and records. Schemas are given, never inferred."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import shutil
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_CENSUS, LEAST_BIRTHS = 100_000, 1_000_000


class SourceError(ValueError):
    pass


def manifest_problems(spark: SparkSession, manifest: dict, folder: str, version: tuple[int, ...] = (0,)) -> list[str]:
    """What is wrong with the files that a manifest lists: absent, another size, another digest, or for a later version."""
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in manifest if Path(folder, n).exists()]) if any(Path(folder, n).exists() for n in manifest) else None
    seen = {r["path"].rsplit("/", 1)[1]: r for r in files.select("path", F.sha2("content", 256).alias("sha"), F.length("content").alias("n")).collect()} if files is not None else {}
    out = []
    for name, want in manifest.items():
        got = seen.get(name)
        if got is None:
            out.append(f"{name}: missing")
        elif got["n"] != want["bytes"]:
            out.append(f"{name}: {got['n']} bytes, not {want['bytes']}")
        elif got["sha"] != want["sha256"]:
            out.append(f"{name}: digest differs")
        if tuple(map(int, str(want.get("min_version", "0")).split("."))) > version:
            out.append(f"{name}: needs version {want['min_version']}")
    return out


def build_manifest(folder: str, names: list[str], **more) -> dict:
    read = lambda n: Path(folder, n).read_bytes()
    return {n: {"sha256": hashlib.sha256(read(n)).hexdigest(), "bytes": len(read(n)), **more} for n in sorted(names)}


def corpus_file(folder: str) -> Path:
    """``corpus.tsv``, else the folder's only ``.tsv``."""
    fixed = Path(folder, "corpus.tsv")
    if fixed.exists():
        return fixed
    found = sorted(Path(folder).glob("*.tsv"))
    if len(found) != 1:
        raise SourceError(f"{folder}: {len(found)} .tsv files, one expected")
    return found[0]


def verified_copy(manifest: dict, source: str, target: str) -> list[str]:
    """Copy the files that a manifest lists, each checked against it on both sides; returns their names."""
    Path(target).mkdir(parents=True, exist_ok=True)
    for name, want in manifest.items():
        for folder in (source, target):
            if folder == target:
                shutil.copyfile(Path(source, name), Path(target, name))
            raw = Path(folder, name).read_bytes()
            if len(raw) != want["bytes"] or hashlib.sha256(raw).hexdigest() != want["sha256"]:
                raise SourceError(f"{folder}/{name} differs from the manifest")
    return sorted(manifest)


CORPUS_VAR, PAIR_VAR = "INKVEIL_CORPUS", "INKVEIL_LATENCY_PAIR"


def resolve_corpus(corpus_id: str | None, registry: dict[str, dict], operator_default: str | None = None, env: dict[str, str] | None = None) -> dict:
    """The corpus named, else the one the environment names, else the operator's default, else the registry's."""
    name = corpus_id or (os.environ if env is None else env).get(CORPUS_VAR, "").strip() or operator_default or next((k for k, v in registry.items() if v.get("default")), None)
    if name not in registry:
        raise SourceError(f"unknown corpus {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]


def essays_tsv(spark: SparkSession, path: str, id_col: str, text_col: str, columns: list[str], where: dict[str, str] | None = None, limit: int | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """``(essay_id, text)`` in file order. A ``limit`` that the file can't fill is refused."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, encoding=encoding, quote='"', escape='"', multiLine=True)
    for c, v in (where or {}).items():
        rows = rows.filter(F.col(c) == v)
    out = rows.select(F.col(id_col).alias("essay_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("n"))
    if limit is not None:
        out = out.orderBy("n").limit(limit)
        if (n := out.count()) < limit:
            raise SourceError(f"{path}: {n} essays, {limit} wanted")
    return out.select("essay_id", "text")


def shipped_essays(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """``(essay_id, text)`` from a JSON list, each text against its pinned digest; both sides must list the same ids."""
    rows = spark.read.json(path, schema="id string, text string", multiLine=True).select(F.col("id").alias("essay_id"), "text")
    pins = spark.createDataFrame(sorted(digests.items()), "pin_id string, sha string")
    both = rows.join(pins, rows["essay_id"] == pins["pin_id"], "full_outer")
    bad = both.filter(F.col("essay_id").isNull() | F.col("pin_id").isNull() | (F.sha2("text", 256) != F.col("sha"))).select(F.coalesce("essay_id", "pin_id")).limit(5).collect()
    if bad:
        raise SourceError(f"{path}: {', '.join(r[0] for r in bad)} differ from the profile")
    return rows


def latency_pair(path: str | None = None, env: dict[str, str] | None = None) -> tuple[dict | None, str | None]:
    """The paired measurement of this machine and the release before, or why there is none: never both."""
    given = path or (os.environ if env is None else env).get(PAIR_VAR, "").strip()
    if not given:
        return None, f"{PAIR_VAR} is unset: no pair was measured on this machine"
    if not Path(given).exists():
        return None, f"{given} is not there"
    try:
        return json.loads(Path(given).read_text("utf-8")), None
    except (OSError, ValueError) as e:
        return None, f"{given} can't be read: {e}"


def pinned(path: str, sha256: str) -> bytes:
    """A file's bytes, if they have the digest that was pinned."""
    raw = Path(path).read_bytes()
    if (found := hashlib.sha256(raw).hexdigest()) != sha256:
        raise SourceError(f"{path}: digest {found}, {sha256} was pinned")
    return raw


def encode_census(rows: list[tuple[str, int]]) -> bytes:
    """The register as compressed text, sorted and without a time stamp: equal registers give equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", fileobj=out, mode="wb", compresslevel=9, mtime=0) as f:
        f.write("".join(f"{n}\t{b}\n" for n, b in sorted(rows)).encode())
    return out.getvalue()


def decode_census(raw: bytes) -> list[tuple[str, int]]:
    """The rows of an encoded register; another order, repeated names or numbers that aren't positive are refused."""
    rows = [(n, int(b)) for n, b in (line.split("\t") for line in gzip.decompress(raw).decode().splitlines())]
    if any(a[0] >= b[0] for a, b in zip(rows, rows[1:])) or any(b <= 0 for _, b in rows):
        raise SourceError("a census register that is not sorted, or has repeated names or counts under one")
    return rows


def census_upstream(spark: SparkSession, path: str, least: int = LEAST_CENSUS, name_col: str = "name", count_col: str = "count") -> DataFrame:
    """``(name, bearers)`` from the register as published: a CSV file with a header, or the only CSV file in a zip."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            members = [m for m in z.namelist() if m.lower().endswith(".csv")]
            if len(members) != 1:
                raise SourceError(f"{path}: {len(members)} CSV files, one expected")
            lines = z.read(members[0]).decode("utf-8-sig").splitlines()
        rows = spark.read.csv(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r["value"]), header=True)
    else:
        rows = spark.read.csv(path, header=True)
    rows = rows.select(F.lower(name_col).alias("name"), F.col(count_col).cast("long").alias("bearers")).filter("name is not null and name <> 'all other names'")
    out = rows.groupBy("name").agg(F.max("bearers").alias("bearers"))
    if (n := out.count()) < least:
        raise SourceError(f"{path}: {n} surnames, {least} at least")
    return out


def census_surnames(spark: SparkSession, path: str, least: int = LEAST_CENSUS, sha256: str | None = None) -> DataFrame:
    """``(name, bearers)``, names folded to lower case; a register under ``least`` rows is taken to be cut short, and one of
    another digest than ``sha256`` is refused."""
    if sha256 is not None:
        pinned(path, sha256)
    rows = spark.read.csv(path, sep="\t", schema="name string, bearers long").filter("name is not null and name <> 'ALL OTHER NAMES'")
    out = rows.groupBy(F.lower("name").alias("name")).agg(F.max("bearers").alias("bearers"))
    if (n := out.count()) < least:
        raise SourceError(f"{path}: {n} surnames, {least} at least")
    return out


def write_census(census: DataFrame, path: str) -> None:
    census.select("name", "bearers").orderBy("name").coalesce(1).write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def given_births(spark: SparkSession, paths: str | list[str], least: int = LEAST_BIRTHS) -> DataFrame:
    """``(name, births)`` summed over years and sexes."""
    rows = spark.read.csv(paths, schema="name string, sex string, births long")
    out = rows.groupBy(F.lower("name").alias("name")).agg(F.sum("births").alias("births"), F.count("*").alias("n")).persist()
    if (n := out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) < least:
        raise SourceError(f"{n} rows of births, {least} at least")
    return out.select("name", "births")


def json_strings(record: Column, keys: list[str]) -> Column:
    """All strings under any of ``keys`` at any depth, JSON inside strings included, in document order.

    Depth is unbounded, which no JSON function of Spark follows, so it is an Arrow function over the record column.
    """
    wanted = frozenset(keys)

    def walk(value, under: bool, out: list[str]) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, under or k in wanted, out)
        elif isinstance(value, list):
            for v in value:
                walk(v, under, out)
        elif isinstance(value, str):
            inner = None
            if value[:1] in "{[":
                try:
                    inner = json.loads(value)
                except ValueError:
                    inner = None
            if isinstance(inner, (dict, list)):
                walk(inner, under, out)
            elif under:
                out.append(value)

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        rows = []
        for text in batch.to_pylist():
            out: list[str] = []
            try:
                walk(json.loads(text), False, out)
            except (TypeError, ValueError):
                out = []
            rows.append(out)
        return pa.array(rows, pa.list_(pa.string()))

    return run.asNondeterministic()(record)


def grouped_text(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """``(group_id, fields)``: one group a line, the line itself or the strings under ``keys`` of a JSON line."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0).withColumn("group_id", F.monotonically_increasing_id())
    return lines.select("group_id", (F.array("value") if keys is None else json_strings(F.col("value"), keys)).alias("fields"))


RECORD = (
    "essay_id string, mode string, frames array<string>, n_redact int, n_keep int, recalled int, kept int, violations array<struct<kind:string,detail:string>>, "
    "round_trips boolean, base_fp_spans int, base_fp_chars int, latency_ms double, char_units int, intervened boolean"
)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records, a JSON object a line; broken lines are dropped."""
    return spark.read.schema(RECORD).json(path, mode="DROPMALFORMED")


def append_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def remaining(cases: DataFrame, done: DataFrame) -> DataFrame:
    """The cases ``(mode, essay_id, …)`` that no record covers yet."""
    return cases.join(done.select("mode", "essay_id").distinct(), ["mode", "essay_id"], "left_anti")


def versioned(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """A JSON document whose ``version`` must be known."""
    found = spark.read.json(path, schema="version int", multiLine=True).first()
    if found is None or found["version"] != version:
        raise SourceError(f"{path}: version {found and found['version']}, not {version}")
    return spark.read.json(path, schema=schema, multiLine=True)


VERSION = 1
_DOCUMENTS = {
    "frames": "version int, fixture_version string, frames array<struct<frame_id:string,grp:string,sentence:string,held_out:boolean,spans:array<struct<entity:string,literal:string,verdict:string,expect_count:int>>>>",
    "gates": "version int, gates array<struct<gate:string,op:string,bar:double,requires:string>>",
    "carrier": "version int, corpus string, plan array<struct<essay_id:string,base_sha256:string,frames:array<string>,slots:array<int>>>",
    "measured": "version int, corpora map<string,map<string,double>>",
}


def _document(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return versioned(spark, path, VERSION, _DOCUMENTS[kind])


def frames_document(spark: SparkSession, path: str) -> DataFrame:
    """``(frame_id, grp, text, held_out, spans)`` as evaluation takes them; a span is to be masked, and a frame is not held
    out, unless the document says otherwise."""
    rows = _document(spark, path, "frames").select(F.explode("frames").alias("f"))
    span = lambda s: F.struct(s["literal"].alias("literal"), s["entity"].alias("kind"), F.coalesce(s["verdict"] == "keep", F.lit(False)).alias("keep"), s["expect_count"].alias("count"))
    spans = F.coalesce(F.transform("f.spans", span), F.array().cast("array<struct<literal:string,kind:string,keep:boolean,count:int>>"))
    return rows.select("f.frame_id", F.coalesce("f.grp", F.lit("recall")).alias("grp"), F.col("f.sentence").alias("text"), F.coalesce("f.held_out", F.lit(False)).alias("held_out"), spans.alias("spans"))


def gates_document(spark: SparkSession, path: str) -> DataFrame:
    """``(gate, op, bar, requires)``; a gate is a floor unless the document says otherwise."""
    rows = _document(spark, path, "gates").select(F.explode("gates").alias("g"))
    return rows.select("g.gate", F.coalesce("g.op", F.lit(">=")).alias("op"), "g.bar", "g.requires")


def carrier_document(spark: SparkSession, path: str) -> DataFrame:
    """``(essay_id, base_sha256, frames, slots)``: frames and slots come in pairs."""
    rows = _document(spark, path, "carrier").select(F.explode("plan").alias("p")).select("p.*")
    bad = F.coalesce(F.size("frames") != F.size("slots"), F.lit(True))
    return rows.withColumn("slots", F.when(bad, F.raise_error(F.concat(F.lit("frames without slots: "), F.col("essay_id")))).otherwise(F.col("slots")))


def measured_document(spark: SparkSession, path: str, corpus: str) -> dict[str, float]:
    """The measurements of one corpus."""
    found = _document(spark, path, "measured").first()["corpora"] or {}
    if corpus not in found:
        raise SourceError(f"{path}: nothing measured for {corpus!r}; it has {', '.join(sorted(found)) or 'none'}")
    return found[corpus]


def canonical_json(rows: DataFrame) -> str:
    """A small table as JSON that is equal for equal tables."""
    return json.dumps(sorted((r.asDict(recursive=True) for r in rows.collect()), key=lambda r: json.dumps(r, sort_keys=True, ensure_ascii=False)), sort_keys=True, ensure_ascii=False, indent=1) + "\n"
