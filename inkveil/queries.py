"""The queries of the library, by name, and the SQL they are compared with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import minting, patterns
from inkveil.functions.columns import located
from inkveil.functions.fold import fold_each
from inkveil.functions.lexicon import KEY_PARTICLES
from inkveil.operators import evaluate, features, structured, tiers
from inkveil.operators.names import Options
from inkveil.plans import evaluation, redaction
from inkveil.sources import cases, fixtures, readers
from inkveil.sources import gazetteer as gaz
from inkveil.streaming import redact as streaming

#: Patterns that both regular expression dialects read alike.
CORE = (patterns.EMAIL, patterns.URL, patterns.IP, patterns.CARD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores, in as many: small files with much work a row. Large ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _masked_core(docs: DataFrame, *more: str) -> DataFrame:
    out = docs.select("doc_id", *more, "text", F.coalesce("text", F.lit("")).alias("t")).withColumn("s", minting.initial(F.col("t")))
    for p in CORE:
        out = out.withColumn("s", minting.substitute(F.col("s"), p.kind, p.regex, p.needs, accept=structured.luhn if p is patterns.CARD else None))
    return out


def mask_structured_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked_core(spread(table(spark, sf_dir, "documents"))).select("doc_id", F.col("s.text").alias("masked_text"), F.col("s.n").cast("bigint").alias("n_masked"))


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _masked_core(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (minting.restore(F.col("s.text"), F.col("s.minted")) == F.col("t")).alias("same"), F.length("t").cast("bigint").alias("n_chars"))


def _mask_one(p: patterns.Pattern, source: str, key: str, col: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, F.coalesce(col, F.lit("")).alias("t")).withColumn("s", minting.initial(F.col("t")))
        s = minting.substitute(F.col("s"), p.kind, p.regex, p.needs, accept=structured.luhn if p is patterns.CARD else None)
        return rows.withColumn("s", s).select(key, F.col("s.text").alias("masked_text"), F.col("s.n").cast("bigint").alias("n_masked"))

    return run


def structured_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structured.mask_structured(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "masked_text", "n_masked", F.to_json("restore_map").alias("restore_map"))


def stub_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(structured.stub(F.coalesce("text", F.lit("")))).alias("masked_md5"))


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders by kind in the masked documents."""
    masked = _masked_core(spread(table(spark, sf_dir, "documents"))).select("doc_id", F.col("s.text").alias("masked_text"))
    return evaluate.kind_census(masked)


def minted_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by relational means: a row a match, ranked by where its original first came up."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", located(F.coalesce("text", F.lit("")), patterns.IP.regex).alias("m"))
    rows = docs.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.text", "m.start")
    first = rows.withColumn("first", F.min("start").over(Window.partitionBy("doc_id", "text")))
    idx = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))
    return first.select("doc_id", F.col("start").cast("bigint").alias("start"), "text", idx.cast("bigint").alias("idx"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = features.tokens(table(spark, sf_dir, "documents"))
    return toks.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum(F.col("start").cast("bigint") * (F.col("pos") + 1)).alias("weighted"),
    )


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = features.tokens(table(spark, sf_dir, "documents"))
    return toks.filter(features.is_stop(F.col("token"))).groupBy("doc_id").agg(F.count("*").alias("n_stop"), F.count_distinct(F.lower("token")).alias("n_words"))


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    heads = features.headings(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.explode(heads).alias("h")).select("doc_id", F.col("h.start").cast("bigint").alias("start"), F.col("h.end").cast("bigint").alias("stop"))


def allcaps_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = features.capital_runs(features.tokens(table(spark, sf_dir, "documents")))
    return runs.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("stop"), "n", (F.col("n") < 3).alias("emphasis"))


def capitalisation_habit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.habit(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("marks", "units", "openings")), "bare_i", "habit")


def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words joined by single spaces: the core of the capital route."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(located(F.coalesce("text", F.lit("")), "[A-Z][a-z]+(?: [A-Z][a-z]+)+")).alias("m"))
    return rows.select("doc_id", F.col("m.start").cast("bigint").alias("start"), "m.text")


def org_suffix_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.get(F.lit(["Bank", "School", "Park", "Museum", "Smith"]), (F.col("p_partkey") % 5).cast("int"))).alias("name"))
    return names.select("p_partkey", features.organisation_kind(F.col("name")).alias("kind"))


def title_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest title at each token; the titles are the lines of two to eight tokens of all documents."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    words = lines.select(F.regexp_extract_all("line", F.lit(features.TOKEN), F.lit(0)).alias("ws"))
    keys = words.filter(F.size("ws").between(2, 8)).select(F.translate(F.lower(F.array_join("ws", " ")), "’", "'").alias("key")).distinct()
    return features.title_matches(docs, keys).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("n").cast("bigint").alias("n"))


def _name_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation, region and customer with a tier; every sixth customer with two."""
    key = lambda c: F.lower(F.translate(c, "#_", "  "))
    nation, region, cust = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), table(spark, sf_dir, "customer")
    parts = [
        nation.select(F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'full' ELSE 'title' END").alias("tier"), key("n_name").alias("key")),
        region.select(F.expr("CASE r_regionkey % 2 WHEN 0 THEN 'short' ELSE 'demonym' END").alias("tier"), key("r_name").alias("key")),
        cust.select(F.explode(F.expr("CASE WHEN c_custkey % 6 = 0 THEN array('full', 'title') WHEN c_custkey % 2 = 0 THEN array('full') ELSE array('title') END")).alias("tier"), key("c_name").alias("key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.lower(F.translate(c, "#_", "  "))
    names = table(spark, sf_dir, "customer").select(key("c_name").alias("key")).unionByName(table(spark, sf_dir, "nation").select(key("n_name").alias("key")))
    names = names.unionByName(table(spark, sf_dir, "region").select(key("r_name").alias("key")))
    return features.tier_of(names, _name_gazetteer(spark, sf_dir), sorted(KEY_PARTICLES)).groupBy("tier").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def surname_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare capitalised words that are the last word of a capitalised pair in the same document, every pair being known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    spans = docs.select("doc_id", F.explode(located(F.col("t"), "[A-Z][a-z]+(?: [A-Z][a-z]+)*")).alias("m")).select("doc_id", "m.start", F.lower("m.text").alias("key"))
    full = spans.filter(F.col("key").contains(" ")).select("key")
    return features.corroborated(spans, full).select("doc_id", F.col("start").cast("bigint").alias("start"), "key")


def fold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document folded: how many, and a digest of the keys, joined by single spaces."""
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f\\x0b]+", -1), lambda x: x != "")
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", fold_each(tokens).alias("keys"))
    return docs.select("doc_id", F.size("keys").cast("bigint").alias("n_tokens"), F.md5(F.array_join("keys", " ")).alias("keys_md5"))


def build_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, cust, supp, nation = (table(spark, sf_dir, t) for t in ("part", "customer", "supplier", "nation"))
    labels = part.select(F.col("p_name").alias("label"), (F.col("p_partkey") % 200).alias("links"))
    census = cust.select(F.concat(F.lit("w"), F.col("c_custkey") % 90).alias("name"), (F.col("c_custkey") * 37 % 40000).alias("b")).groupBy("name").agg(F.max("b").alias("bearers"))
    births = supp.select(F.concat(F.lit("w"), F.col("s_suppkey") % 50).alias("name"), (F.col("s_suppkey") * 53 % 3600).alias("b")).groupBy("name").agg(F.sum("b").alias("births"))
    one = part.select(F.concat(F.lit("w"), F.col("p_partkey") % 90).alias("label"), (F.col("p_partkey") % 200).alias("links"))
    towns = nation.select(F.col("n_name").alias("label"), (F.col("n_nationkey") * 20).alias("links"))
    return tiers.build(labels, towns, labels, one, one.unionByName(towns), census, births)


def census_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), F.col("c_custkey") % 90).alias("name"), (F.col("c_custkey") * 37 % 40000).alias("b")).groupBy("name").agg(F.max("b").alias("bearers"))
    return evaluate.exposure(census, _tiers(spark, sf_dir))


def overfire_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _masked_core(table(spark, sf_dir, "documents"), "source")
    return evaluate.over_fire(rows.select("source", "text", F.col("s.n").cast("bigint").alias("n_masked")), "source")


def tally_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed and total in four groupings at once: orders as the scored spans."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2 == 0).alias("held_out"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("frame_id"), (F.col("o_totalprice") > 100000).alias("passed"))
    return evaluate.tally(rows)


def billed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.billed_units(table(spark, sf_dir, "documents"), "source")


def corpus_band_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.band(table(spark, sf_dir, "documents"), 1000, 4000, 20)


def sidecar_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases not yet recorded: documents by mode, labels as the records."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("essay_id"), F.explode(F.array(F.lit("local"), F.lit("stub"))).alias("mode"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("essay_id"), F.when(F.col("toxic") == 1, "stub").otherwise("local").alias("mode"))
    return readers.remaining(docs, done)


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), "event_type", "value")


def carrier_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as frames, put into all documents at a third and two thirds; the frames, numbered densely, take turns."""
    from pyspark.sql import Window

    essays = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("essay_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = table(spark, sf_dir, "benchmark")
    number = F.row_number().over(Window.orderBy("item_id", "text")).cast("bigint") - 1
    sentences = items.select(number.alias("frame_id"), "text")
    turn = lambda k: F.pmod(F.col("essay_id") + k, F.col("n_frames"))
    slots = F.array(F.floor(F.length("text") * 2 / 3).cast("int"), F.floor(F.length("text") / 3).cast("int"))
    counted = essays.crossJoin(F.broadcast(items.agg(F.count("*").alias("n_frames"))))
    plan = counted.select("essay_id", F.sha2("text", 256).alias("base_sha256"), F.array(turn(0), turn(1)).alias("frames"), slots.alias("slots"))
    return evaluate.inject(essays, plan, sentences).select("essay_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


def corpus_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("essay_id"))
    labels = table(spark, sf_dir, "labels")
    return evaluate.unaccounted(docs, labels.filter("quality = 1").select(F.col("doc_id").alias("essay_id")), labels.filter("quality = 0").select(F.col("doc_id").alias("essay_id")))


def batch_join_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a document joined by the separator, masked once, split again."""
    r = redaction.Redactor("local", Options(level="identity"), Options(level="identity"))
    out = r.redact_outbound_batch(table(spark, sf_dir, "conversations"), on="conv_id", order="turn")
    return out.select("conv_id", F.col("turn").alias("turn"), "masked_text", "batched")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.to_json(F.struct(F.col("event_type").alias("ref"), "value"))
    record = F.to_json(F.struct(F.col("event_type").alias("page"), F.struct(F.col("props").alias("other"), inner.alias("blob")).alias("more")))
    rows = table(spark, sf_dir, "events").select("event_id", readers.json_strings(record, ["page", "ref"]).alias("fields"))
    return rows.select("event_id", F.array_join("fields", "|").alias("fields"))


def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


def held_out_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "part").select(F.lower("p_name").alias("full_name"), F.element_at(F.split(F.lower("p_name"), " "), -1).alias("surname"), (F.col("p_size") % 5).alias("domain"))
    return evaluate.figures(people, _tiers(spark, sf_dir))


def gates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates over figures of the tables: what can't be measured here is named as such."""
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    percent = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    one = lambda df, gate, value: df.agg(value.cast("double").alias("value")).select(F.lit(gate).alias("gate"), "value")
    measured = one(orders, "held_out_recall", percent(F.col("o_totalprice") > 0)).unionByName(one(orders, "keep_precision", percent(F.col("o_orderstatus") != "P")))
    measured = measured.unionByName(one(parts, "round_trip", percent(F.col("p_size") > 0))).unionByName(one(parts, "unaccounted_violations", F.sum(F.when(F.col("p_name").isNull(), 1).otherwise(0))))
    measured = measured.unionByName(one(orders, "over_fire_prose", F.avg(F.when(F.col("o_orderpriority") == "5-LOW", 1.0).otherwise(0.0))))
    measured = measured.unionByName(one(_tiers(spark, sf_dir), "asset_entries", F.count("*"))).unionByName(one(parts, "latency_regression", F.lit(1.0)))
    return evaluate.gates(spark, measured, {"corpus"})


def seed_gazetteer(spark: SparkSession) -> DataFrame:
    return gaz.from_dict(spark, fixtures.SEED)


def _frames_masked(spark: SparkSession) -> DataFrame:
    frames = evaluate.frames(spark).withColumnRenamed("spans", "labels")
    who = fixtures.IDENTITY
    frames = frames.withColumn("who", structured.identity_struct(*(F.lit(who[c]) for c in ("first_name", "last_name", "school_name"))))
    return redaction.build(spark, "local", seed_gazetteer(spark)).redact_inbound(frames, identity_col="who")


def redact_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the labelled sentences, by group and verdict."""
    scored = evaluate.score(_frames_masked(spark))
    return scored.groupBy("grp", "verdict").agg(F.sum(F.col("passed").cast("bigint")).alias("passed"), F.count("*").alias("total"))


#: Kinds of names by tier of :data:`inkveil.sources.cases.TIERS`: full names, places and titles are to stay.
_KEPT = (1, 3, 4)


def _labelled(customers: DataFrame, case: str) -> DataFrame:
    """A case's sentences as evaluation cases; the text they are put into mentions another customer's surname, or nobody."""
    name = F.concat_ws(" ", "first", "last")
    kind = F.when(F.col("tier_no") == 6, "LOCATION").otherwise("NAME")
    label = F.struct(F.lit(case).alias("frame_id"), name.alias("literal"), kind.alias("kind"), F.col("tier_no").isin(*_KEPT).alias("keep"), F.lit(None).cast("int").alias("count"), (F.pmod("c_custkey", F.lit(3)) == 0).alias("held_out"))
    base = F.when(F.pmod("c_custkey", F.lit(5)) == 0, cases.filled("Nobody asked {L} or @CAPS1 there.")).otherwise("It rained all day.")
    return cases.documents(customers, case).select(F.col("c_custkey").alias("essay_id"), "text", base.alias("base"), F.array(label).alias("labels"))


def _records(spark: SparkSession, sf_dir: str, *arms: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    out = None
    for arm in arms:
        r = evaluation.arm(spark, arm, cases.gazetteer(customers))
        rows = evaluation.run(_labelled(spread(customers), "plain"), r, arm)
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.summarize(_records(spark, sf_dir, "local", "local-gazetteer-lowercase"))
    return out.select("mode", *(F.col(c).cast("bigint").alias(c) for c in ("cases", "recall_spans", "precision_spans", "violations")), *(c for c in out.columns if c not in ("mode", "cases", "recall_spans", "precision_spans", "violations")))


def evaluation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_frame(_records(spark, sf_dir, "local-candidates", "path-gazetteer"))


def frame_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks say of results that are wrong in a way that follows from the customer's key."""
    name = F.concat_ws(" ", "first", "last")
    people = cases.people(table(spark, sf_dir, "customer"))
    text = cases.filled("Then we met {F} {L} at noon.")
    masked = F.element_at(F.array(F.lit("Then we met {NAME_1} at noon."), text, cases.filled("Then we met {NAME_1} {L} at noon."), F.lit("Then we met {ODD_1} at noon."), F.lit("We saw {NAME_1}.")), F.pmod("c_custkey", F.lit(5)).cast("int") + 1)
    label = F.struct(name.alias("literal"), F.lit("NAME").alias("kind"), (F.pmod("c_custkey", F.lit(7)) == 0).alias("keep"), F.lit(None).cast("int").alias("count"))
    found = evaluate.violations(masked, text, F.replace(masked, F.lit("{NAME_1}"), name), F.array(label))
    return people.select("c_custkey", F.explode(found).alias("v")).select("c_custkey", "v.kind", "v.detail")


def wrong_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of another kind than the label's: settlements that were expected to be names."""
    people = cases.people(table(spark, sf_dir, "customer"))
    label = F.struct(F.concat_ws(" ", "first", "last").alias("literal"), F.lit("NAME").alias("kind"), (F.pmod("c_custkey", F.lit(3)) == 0).alias("keep"))
    rows = people.select(F.col("c_custkey").alias("frame_id"), F.when(F.col("tier_no") == 6, "LOCATION").otherwise("NAME").alias("token_kind"), cases.filled("{F} {L}").alias("region"), F.array(label).alias("labels"))
    return evaluate.wrong_type(rows).select("frame_id", "token_kind", "region")


def _overfire(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two fields of feedback a customer, and an essay each that sets up the customer's name."""
    customers = table(spark, sf_dir, "customer")
    people = cases.people(spread(customers))
    fields = F.explode(F.array(F.struct(F.lit(0).alias("field_no"), cases.filled("You said that {L} won.").alias("text")), F.struct(F.lit(1).alias("field_no"), cases.filled("Then say who {F} is.").alias("text"))))
    feedback = people.select(F.col("c_custkey").alias("group_id"), fields.alias("f")).select("group_id", "f.*")
    essays = people.select(F.col("c_custkey").alias("group_id"), cases.filled("We read {F} {L} today.").alias("text"))
    keys = cases.gazetteer(customers)
    return evaluation.over_fire_levels(feedback, essays, {n: redaction.build(spark, "local", keys, level=n, outbound=n) for n in ("identity", "gazetteer-lowercase")})


def overfire_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overfire(spark, sf_dir)[0]


def overfire_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overfire(spark, sf_dir)[1]


def label_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a class tree: parts by brand, brands below makers; some brands are taken out again."""
    part = table(spark, sf_dir, "part")
    entities = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), (F.col("p_partkey") % 200).alias("links"))
    classes = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("class")).unionByName(part.filter("p_size > 40").select(F.col("p_partkey").alias("id"), F.lit("large").alias("class")))
    tree = part.select(F.col("p_brand").alias("class"), F.concat(F.lit("maker "), F.substring("p_brand", 7, 1)).alias("parent")).distinct()
    out = tiers.labels(entities, classes, tree, {"maker 1", "maker 2"}, 30, {"large"})
    return out.groupBy("label").agg(F.count("*").alias("n"), F.max("links").alias("links"))


def gazetteer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gaz.counts(_tiers(spark, sf_dir))
    return out.select("tier", "n", F.col("most_tokens").cast("bigint").alias("most_tokens"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole redaction at the default level over all documents."""
    out = redaction.build(spark, "local", seed_gazetteer(spark)).redact_inbound(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "masked_text", "n_masked", "intervened", "habit")


def redact_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = redaction.build(spark, "local", seed_gazetteer(spark))
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    essays = turns.filter("turn = 0")
    out = r.redact_outbound(turns.filter("turn > 0"), essays)
    return out.select("doc_id", "turn", "masked_text", "n_masked")


def _case(case: str, **switches):
    """The verdicts on one sentence a customer, by the gazetteer of all customers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customers = table(spark, sf_dir, "customer")
        r = redaction.build(spark, "local", cases.gazetteer(customers), options=Options(**{k: v for k, v in switches.items() if k not in ("level", "text")}), level=switches.get("level"))
        out = r.redact_inbound(cases.documents(spread(customers), switches.get("text", case)))
        return out.select("c_custkey", "masked_text")

    return run


def case_topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer's name is the topic, so it stays whatever its tier."""
    row = cases.people(table(spark, sf_dir, "customer")).filter("c_custkey = 1").first()
    return _case("plain", topical=frozenset({f"{row['first']} {row['last']}"}))(spark, sf_dir)


def case_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback may repeat the surnames of full names that its essay sets up."""
    customers = spread(table(spark, sf_dir, "customer"))
    r = redaction.build(spark, "local", cases.gazetteer(customers), outbound="gazetteer-lowercase")
    feedback = cases.people(customers).select("c_custkey", cases.filled("You said that {L} won.").alias("text"))
    essays = cases.people(customers).select("c_custkey", cases.filled("We read {F} {L} today.").alias("text"))
    return r.redact_outbound(feedback, essays, on="c_custkey").select("c_custkey", "masked_text")


def case_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writer's own names and school; of every third customer the first name is also a word."""
    people = cases.people(spread(table(spark, sf_dir, "customer")))
    first = F.when(F.pmod("c_custkey", F.lit(3)) == 0, "Grace").otherwise(F.col("first"))
    school = F.concat(F.lit("Lake "), F.replace("last", F.lit("Quin"), F.lit("Vor")), F.lit(" High"))
    text = F.replace(cases.filled("By {F} {L}, also {L}, {F} and {L}'s. {F} went to {S}, LVH, lqh."), F.lit("{S}"), F.lower(school))
    rows = people.withColumn("first", first).select("*", text.alias("text"), school.alias("school"))
    who = structured.identity_struct(F.col("first"), F.col("last"), F.col("school"))
    return structured.mask_structured(rows.withColumn("who", who), identity_col="who").select("c_custkey", "masked_text")


#: An identifier of each kind with what only looks like one; digits of the customer's key stand for BB, CCC and DDDD.
_STRUCTURED = {
    "ssn": "no CCC-BB-DDDD here", "phone": "call (CCC) 555-DDDD x9 or +1 CCC.555.DDDD, not 1CCC555DDDD.", "address": "at KEY N. Oak Hill Road, then KEY Elm trees",
    "birth": "DOB: 1/BB/1CCC; born in 1CCC", "username": "ask @u_KEY, not @PERSON1 or ab@{L}", "zip": "in OH 1DDDD-DDDD. But 1DDDD apples", "age": "I am 33, and BB years old is BB more",
}


def _structured_case(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, key = cases.filled(_STRUCTURED[kind]), F.col("c_custkey")
        digits = lambda by, n: F.lpad((key * by % 10**n).cast("string"), n, "0")
        for mark, value in (("DDDD", digits(31, 4)), ("CCC", digits(13, 3)), ("BB", digits(7, 2)), ("KEY", key.cast("string"))):
            text = F.replace(text, F.lit(mark), value)
        rows = cases.people(table(spark, sf_dir, "customer")).select("c_custkey", text.alias("text"))
        return structured.mask_structured(rows).select("c_custkey", "masked_text")

    return run


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named; with a local master a
    temporary one where neither is set, with any other that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = named.get() if named.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkveil-shared-")
    return root.rstrip("/")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling counts of the events, by a stream over the file: all windows, as a complete result."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = _shared_folder(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", False).parquet(sf_dir)
    out = streaming.run_available(streaming.windowed(stream, ["event_type"], width="1 day"), f"{folder}/inkveil-stream-{uuid.uuid4().hex}", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.sessions(table(spark, sf_dir, "events"), ["user_id"], gap="30 minutes")
    return out.select("user_id", "session_start", "session_end", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "mask_structured_core": mask_structured_core, "restore_roundtrip": restore_roundtrip,
        "mask_email": _mask_one(patterns.EMAIL, "documents", "doc_id", "text"), "mask_ip": _mask_one(patterns.IP, "documents", "doc_id", "text"),
        "mask_card_luhn": _mask_one(patterns.CARD, "documents", "doc_id", "text"), "mask_url_pages": _mask_one(patterns.URL, "pages", "page_id", "html"),
        "structured_all": structured_all, "stub_mask": stub_mask, "kind_counts": kind_counts, "minted_dense_rank": minted_dense_rank,
        "token_offsets": token_offsets, "stopword_filter": stopword_filter, "heading_lines": heading_lines, "allcaps_runs": allcaps_runs,
        "capitalisation_habit": capitalisation_habit, "candidate_spans": candidate_spans, "org_suffix_classify": org_suffix_classify,
        "title_ngrams": title_ngrams, "tier_lookup": tier_lookup, "surname_corroboration": surname_corroboration, "fold_names": fold_names,
        "build_tiers": build_tiers, "census_exposure": census_exposure, "overfire_by_source": overfire_by_source,
        "tally_grouping_sets": tally_grouping_sets, "billed_units": billed_units, "corpus_band_select": corpus_band_select, "sidecar_resume": sidecar_resume,
        "latency_percentiles": latency_percentiles, "carrier_injection": carrier_injection, "corpus_reconciliation": corpus_reconciliation,
        "batch_join_split": batch_join_split, "json_fields": json_fields, "manifest_digests": manifest_digests, "held_out_figures": held_out_figures,
        "gates_report": gates_report, "redact_frames": redact_frames, "frame_violations": frame_violations, "wrong_types": wrong_types,
        "evaluation_summary": evaluation_summary, "evaluation_frames": evaluation_frames, "overfire_levels": overfire_levels, "overfire_spans": overfire_spans,
        "label_predicates": label_predicates, "gazetteer_counts": gazetteer_counts, "redact_documents": redact_documents,
        **{f"case_{c}": _case(c) for c in cases.TEXTS}, **{f"structured_{k}": _structured_case(k) for k in _STRUCTURED},
        "case_uncorroborated": _case("surname_again", corroborate=False), "case_unrelated": _case("relation_before", title_relation_refusal=False),
        "case_capitals_only": _case("lower_case", level="gazetteer"), "case_topical": case_topical, "case_carried": case_carried, "case_identity": case_identity,
        "redact_outbound": redact_outbound, "stream_event_windows": stream_event_windows, "session_counts": session_counts,
    }
