from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions import lexicon, minting
from inkveil.functions.fold import fold, fold_column
from inkveil.operators import evaluate, features, names, structured, tiers
from inkveil.operators.names import Gazetteer, Options
from inkveil.plans import config, redaction
from inkveil.queries import _frames_masked, seed_gazetteer
from inkveil.sources import fixtures, gazetteer, readers


@pytest.fixture(scope="module")
def gaz():
    keys: dict[str, int] = {}
    for tier, ks in fixtures.SEED.items():
        for k in ks:
            keys[k] = keys.get(k, 0) | names.BIT[tier]
    return Gazetteer(keys)


def masked(text, gaz, **kw):
    return names.mask(text, [], Options(**kw), gaz)[0]


def one(spark, text, **kw):
    return structured.mask_structured(spark.createDataFrame([(1, text)], "doc_id int, text string"), **kw).first()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("to a.b@x.org, not a@b", "to {EMAIL_1}, not a@b"),
        ("see https://x.org/a?b=1 or www.x.co.uk/p", "see {URL_1} or {URL_2}"),
        ("ssn 123-45-6789 but 000-12-3456", "ssn {US_SOCIAL_SECURITY_NUMBER_1} but 000-12-3456"),
        ("host 10.20.30.40 and 300.1.1.1", "host {IP_ADDRESS_1} and 300.1.1.1"),
        ("(555) 123-4567 x12, 5551234567", "{PHONE_1}, 5551234567"),
        ("at 12 N. Oak Hill Road.", "at {ADDRESS_1}"),
        ("DOB: 1/2/2003", "{DATE_OF_BIRTH_1}"),
        ("@some_one and @PERSON1 and a@b", "{USERNAME_1} and @PERSON1 and a@b"),
        ("4012 8888 8888 1881, 4012 8888 8888 1882", "{CREDIT_DEBIT_CARD_NUMBER_1}, 4012 8888 8888 1882"),
        ("card 4012 8888 8888 1881.", "card {CREDIT_DEBIT_CARD_NUMBER_1}."),
        ("Dayton, OH 45402", "Dayton, OH {ZIP_CODE_1}"),
        ("12345 years", "12345 years"),
        ("I am 14 and aged 9, 12 years old", "I am {AGE_1} and aged {AGE_2}, {AGE_3} years old"),
        ("x@y.org then x@y.org then z@y.org", "{EMAIL_1} then {EMAIL_1} then {EMAIL_2}"),
        ("né 😀 10.0.0.1", "né 😀 {IP_ADDRESS_1}"),
    ],
)
def test_patterns(spark, text, want):
    assert one(spark, text)["masked_text"] == want


def test_null_and_empty(spark):
    rows = structured.mask_structured(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r["masked_text"], r["n_masked"]) for r in rows] == [(None, 0), ("", 0)]


def test_restores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = structured.mask_structured(docs)
    bad = out.filter(~minting.restore(F.col("masked_text"), F.col("minted")).eqNullSafe(F.col("text")))
    assert bad.count() == 0
    many = " ".join(f"u{k}@x.org" for k in range(12))
    r = one(spark, many)
    back = spark.createDataFrame([(r["masked_text"], r["restore_map"])], "m string, p map<string,string>").select(evaluate.restored(F.col("m"), F.col("p"))).first()[0]
    assert back == many


@pytest.mark.parametrize(
    ("first", "last", "extra", "school", "text", "want"),
    [
        ("Ann", "O'Brien (Jr.)", None, None, "by Ann O'Brien (Jr.) here", "by {NAME_1} here"),
        ("Will", "Young", None, None, "Will you stay young, Will Young?", "Will you stay young, {NAME_1}?"),
        ("Ines", "Ortiz", ["Nena"], None, "INES'S nena, Ortiz’s; Ortizar", "{NAME_2} {NAME_3}, {NAME_1}; Ortizar"),
        (None, None, None, "Lake Valley High School", "LVHS lvhs lake valley high school", "{SCHOOL_2} lvhs {SCHOOL_1}"),
        (None, "Zoë", None, None, "zoë ZOË Zoëy", "{NAME_1} {NAME_2} Zoëy"),
    ],
)
def test_identity(spark, first, last, extra, school, text, want):
    df = spark.createDataFrame([(text, (first, last, school, extra))], f"text string, who {structured.IDENTITY}")
    assert structured.mask_structured(df, identity_col="who").first()["masked_text"] == want


def test_frames_all_pass(spark):
    masked_frames = _frames_masked(spark)
    failed = evaluate.score(masked_frames).filter("not passed").collect()
    assert failed == []
    back = evaluate.restored(F.col("masked_text"), F.col("restore_map"))
    assert masked_frames.filter(back != F.col("text")).count() == 0


def test_numbers_come_from_the_right(gaz):
    text, minted, n, _, _ = names.mask("so Dmitri Falkenberg met Imani Quist.", [("NAME", 1, "Ada")], Options(), gaz)
    assert text == "so {NAME_3} met {NAME_2}." and n == 2 and ("NAME", 3, "Dmitri Falkenberg") in minted


def test_idempotent(gaz):
    for f in fixtures.FRAMES:
        once = masked(f.sentence, gaz)
        assert masked(once, gaz) == once


def test_repeated_run_in_one_match_masks_both(gaz):
    assert masked("THEY TOLD YOLANDA AND YOLANDA AND YOLANDA.", gaz) == "THEY TOLD {NAME_1} AND {NAME_1} AND {NAME_1}."


def test_levels(gaz):
    assert masked("then dmitri falkenberg sang", gaz, level="gazetteer") == "then dmitri falkenberg sang"
    assert masked("then dmitri falkenberg sang", gaz) == "then {NAME_1} sang"
    assert masked("we saw Yolanda", gaz, numbered=False) == "we saw {NAME}"


def test_relation_reads_the_original_text(gaz):
    text = "Ray Bradbury wrote it. Bradbury and our neighbor Imani Quist read it."
    assert masked(text, gaz).startswith("Ray Bradbury wrote it. {NAME_2} and our neighbor {NAME_1}")
    assert masked(text, gaz, relation_refusal=False).startswith("Ray Bradbury wrote it. Bradbury and")


def test_topical_and_carry(gaz):
    assert masked("I met Imani Quist.", gaz, topical=frozenset({"Imani Quist"})) == "I met Imani Quist."
    keeps = names.carried_keeps("I read about Marie Curie. Imani Curie is my aunt.", Options(), gaz)
    assert keeps == {"marie"}
    assert names.carried_keeps("I read about Marie Curie.", Options(), gaz, ["Marie Stone"]) == {"curie"}


def test_a_gazetteer_too_large_to_broadcast_gives_the_same(spark, sf, monkeypatch):
    small = redaction.build(spark, "local", seed_gazetteer(spark))
    monkeypatch.setattr(redaction, "MOST_KEYS", 3)
    large = redaction.build(spark, "local", seed_gazetteer(spark))
    assert small.table is None and large.gazetteer is None and large.table is not None
    frames = evaluate.frames(spark).filter("grp <> 'structured'").select("frame_id", "text")
    of = lambda r: sorted((x["text"], x["masked_text"]) for x in r.redact_inbound(frames.unionByName(frames)).collect())
    assert of(large) == of(small) and sum(a != b for a, b in of(large)) > 40
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    same = lambda r: sorted(map(repr, r.redact_inbound(docs).select("doc_id", "masked_text", "n_masked").collect()))
    assert same(small) == same(large)
    essays = spark.createDataFrame([(1, "Marie Curie won."), (2, "Nothing."), (3, None)], "doc_id int, text string")
    back = spark.createDataFrame([(1, 0, "You wrote that Curie and Quist won."), (2, 0, "You wrote that Marie left.")], "doc_id int, field_no int, text string")
    both = [sorted((x["doc_id"], x["masked_text"]) for x in r.redact_outbound(back, essays).collect()) for r in (small, large)]
    assert both[0] == both[1] and both[0][0][1].startswith("You wrote that Curie and {NAME_1}")


def test_outbound(spark):
    r = redaction.build(spark, "local", seed_gazetteer(spark), level="gazetteer")
    essays = spark.createDataFrame([(1, "Marie Curie won."), (2, "Nothing.")], "doc_id int, text string")
    back = spark.createDataFrame([(1, 0, "You wrote that Curie and Quist won."), (2, 0, "You wrote that Marie left.")], "doc_id int, field_no int, text string")
    got = {x["doc_id"]: x["masked_text"] for x in r.redact_outbound(back, essays).collect()}
    assert got == {1: "You wrote that Curie and {NAME_1} won.", 2: "You wrote that {NAME_1} left."}


def test_batch(spark):
    r = redaction.build(spark, "local", seed_gazetteer(spark))
    rows = [(1, 0, "Mail a@x.org"), (1, 1, ""), (1, 2, "again a@x.org b@x.org"), (2, 0, "left ␞␞␞ right a@x.org"), (2, 1, f"x{redaction.SEPARATOR}y"), (3, 0, None)]
    df = spark.createDataFrame(rows, "doc_id int, field_no int, text string")
    got = {(x["doc_id"], x["field_no"]): (x["masked_text"], x["batched"]) for x in r.redact_outbound_batch(df).collect()}
    assert got[1, 2] == ("again {EMAIL_1} {EMAIL_2}", True) and got[1, 1] == ("", True)
    assert got[2, 0] == ("left ␞␞␞ right {EMAIL_1}", False) and got[2, 1][1] is False and got[3, 0] == (None, True)


def test_stub_and_off(spark):
    assert redaction.build(spark, False) is None
    df = spark.createDataFrame([("a@x.org 555-123-4567",)], "text string")
    assert redaction.build(spark, "stub").redact_inbound(df).first()["masked_text"] == "{EMAIL} {PHONE}"


def test_config():
    assert config.mode(None, {}) == "off" and config.mode(None, {"INKVEIL_ENV": "prod"}) == "local"
    assert config.mode("simulate") == "stub" and config.mode("nonsense") == "off" and config.mode(True) == "local"
    assert config.mode(None, {"PII_REDACTION": "on"}) == "local"
    assert config.level("nonsense") == "gazetteer-lowercase" and config.level("off") == "identity"
    assert config.outbound_level(None, "identity", {}) == "identity" and config.outbound_level("names") == "gazetteer"


def test_fold(spark):
    cases = ["Joan of Arc", "Léa’s", "O’Brien—Nuñez", "  A.  B ", "James'", "Ångström's", "students'", "Zoë's"]
    df = spark.createDataFrame([(c,) for c in cases], "n string").select("n", fold_column(F.col("n")).alias("k"))
    assert {r["n"]: r["k"] for r in df.collect()} == {c: fold(c) for c in cases}


def test_stop_columns_agree(spark):
    toks = ["Don’t", "IT'S", "hasn't", "Dmitri", "the.", "friends'", "I'd", "u.s.", "s"]
    df = spark.createDataFrame([(t,) for t in toks], "t string").select("t", features.is_stop(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == {t: names.is_stop(t) for t in toks}


def test_features_agree(spark, sf):
    """Headings and token offsets as columns are those of the scan."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = docs.select("doc_id", "text", features.headings(F.col("text")).alias("h")).collect()
    for r in rows:
        assert [(x["start"], x["end"]) for x in r["h"]] == names.headings(r["text"])
    toks: dict = {}
    for t in features.tokens(docs).collect():
        toks.setdefault(t["doc_id"], []).append((t["start"], t["end"], t["token"]))
    for r in rows:
        assert sorted(toks.get(r["doc_id"], [])) == [(m.start(), m.end(), m[0]) for m in names._TOKEN.finditer(r["text"])]


def test_partitions_dont_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = redaction.build(spark, "local", seed_gazetteer(spark))
    run = lambda n: sorted((x["doc_id"], x["masked_text"]) for x in r.redact_inbound(docs.repartition(n)).select("doc_id", "masked_text").collect())
    assert run(1) == run(8)


def test_asset_round_trip(spark, tmp_path):
    g = seed_gazetteer(spark)
    a, b = str(tmp_path / "a.gz"), str(tmp_path / "b.gz")
    gazetteer.write_text(g, a, {"cut": "x"})
    gazetteer.write_text(g.repartition(3), b, {"cut": "x"})
    assert open(a, "rb").read() == open(b, "rb").read()
    assert sorted(map(tuple, gazetteer.read_text(spark, a).collect())) == sorted(map(tuple, g.collect()))
    assert gazetteer.describe(spark, a)["meta"] == {"cut": "x"}
    manifest = readers.build_manifest(str(tmp_path), ["a.gz"])
    assert readers.manifest_problems(spark, manifest, str(tmp_path)) == []
    manifest["a.gz"]["bytes"] += 1
    assert len(readers.manifest_problems(spark, {**manifest, "zz": {}}, str(tmp_path))) == 2


@pytest.mark.parametrize("text", ["#!tier full 2\nx y\n", "#!gazetteer 4\n", "#!gazetteer 5\n#!tier full 2\nx y\n", "#!gazetteer 5\n#!tier odd 1\nx\n"])
def test_broken_assets(spark, tmp_path, text):
    p = tmp_path / "g.txt"
    p.write_text(text)
    with pytest.raises(gazetteer.AssetError):
        gazetteer.read_text(spark, str(p)).count()


@pytest.mark.parametrize("text", ["#!list a 1\nx\n", "#!lexicon 1\n#!list a 2\nx X\n", "#!lexicon 1\nx\n"])
def test_broken_lexicons(text):
    with pytest.raises(lexicon.LexiconError):
        lexicon.parse(text)
    assert len(lexicon.stop_words()) == 421


def test_tier_bounds(spark):
    labels = lambda *rows: spark.createDataFrame(list(rows), "label string, links long")
    counts = lambda c, *rows: spark.createDataFrame(list(rows), f"name string, {c} long")
    out = tiers.build(
        labels(("Ana B. Cole", 100), ("Ana B. Cole", 3), ("Eve Dorn", 99), ("Vincent van Gogh", 100), ("Solo", 500)),
        labels(("Rio", 149), ("Lima", 150), ("Elm Park", 30), ("Oak Park", 29)),
        labels(("The One", 50), ("The Raven", 10), ("Dune", 90), ("Late Crow", 9)),
        labels(("Norse", 1), ("Ada", 1), ("Dane", 1)),
        labels(("Elm Park", 40), ("Toledo", 30), ("Akron", 29), ("Ada", 60), ("Cole", 60)),
        counts("bearers", ("cole", 25_000), ("gogh", 24_999), ("dane", 10_000), ("toledo", 9_999)),
        counts("births", ("ada", 1_800), ("bo", 1_799), ("x", 9_999), ("jo-ann", 9_999)),
    )
    got: dict[str, set] = {}
    for r in out.collect():
        got.setdefault(r["tier"], set()).add(r["key"])
    assert got["full"] == {"ana b cole", "ana cole", "eve dorn", "vincent van gogh"}
    assert got["short"] == {"gogh", "van gogh"}
    assert got["place"] == {"lima", "elm park"} and got["given"] == {"ada"}
    assert got["title"] == {"the raven"} and got["demonym"] == {"norse"} and got["settlement"] == {"toledo"}


def test_sources(spark, tmp_path):
    tsv = tmp_path / "essays.tsv"
    tsv.write_bytes("essay_id\tessay_set\tessay\n1\t8\tcaf\xe9\n2\t7\tno\n3\t8\tyes\n".encode("latin-1"))
    rows = readers.essays_tsv(spark, str(readers.corpus_file(str(tmp_path))), "essay_id", "essay", ["essay_id", "essay_set", "essay"], {"essay_set": "8"}, 2)
    assert [tuple(r) for r in rows.collect()] == [("1", "café"), ("3", "yes")]
    with pytest.raises(readers.SourceError):
        readers.essays_tsv(spark, str(tsv), "essay_id", "essay", ["essay_id", "essay_set", "essay"], {"essay_set": "8"}, 3)
    with pytest.raises(readers.SourceError):
        readers.resolve_corpus("x", {"a": {}})
    with pytest.raises(readers.SourceError):
        (tmp_path / "c.tsv").write_text("a\t1\n")
        readers.census_surnames(spark, str(tmp_path / "c.tsv"))
    assert readers.census_surnames(spark, str(tmp_path / "c.tsv"), 1).count() == 1
    lines = tmp_path / "g.jsonl"
    lines.write_text('{"a": {"text": "x", "n": [{"text": "y"}]}, "s": "{\\"text\\": \\"z\\"}"}\nbroken\n')
    assert [r["fields"] for r in readers.grouped_text(spark, str(lines), ["text"]).collect()] == [["x", "y", "z"], []]


def test_sidecar(spark, tmp_path):
    path = str(tmp_path / "r")
    readers.append_records(spark.createDataFrame([("1", "local")], "essay_id string, mode string"), path)
    (tmp_path / "r" / "broken.json").write_text("{oops\n")
    cases = spark.createDataFrame([("1", "local"), ("1", "stub")], "essay_id string, mode string")
    assert [tuple(r) for r in readers.remaining(cases, readers.records(spark, path)).select("mode", "essay_id").collect()] == [("stub", "1")]


def test_violations_are_found(spark):
    label = lambda lit, keep=False: (lit, "NAME", keep, None)
    rows = [
        ("leak", "Imani Quist left", "Imani Quist left", [label("Imani Quist")]), ("partial-leak", "{NAME_1} Quist left", "Imani Quist left", [label("Imani Quist")]),
        ("keep-destroyed", "{NAME_1} won", "Curie won", [label("Curie", True)]), ("unknown-placeholder", "{ODD_1} won", "x won", []), ("chunk-alignment", "other words", "x won", []),
    ]
    df = spark.createDataFrame(rows, "want string, m string, t string, labels array<struct<literal:string,kind:string,keep:boolean,count:int>>")
    for r in df.select("want", evaluate.violations(F.col("m"), F.col("t"), F.col("t"), F.col("labels")).alias("v")).collect():
        assert r["want"] in [v["kind"] for v in r["v"]]


def test_injection_guards(spark):
    essays = spark.createDataFrame([("1", "One. Two, said Dr. Who. Three.")], "essay_id string, text string")
    points = essays.select(evaluate.injection_points(F.col("text")).alias("p")).first()["p"]
    assert points == [5, 24]
    plan = spark.createDataFrame([("1", "bad", ["f"], [5])], "essay_id string, base_sha256 string, frames array<string>, slots array<int>")
    sentences = spark.createDataFrame([("f", "New.")], "frame_id string, text string")
    with pytest.raises(Exception, match="differs from the plan"):
        evaluate.inject(essays, plan, sentences).collect()
    good = plan.withColumn("base_sha256", F.sha2(F.lit("One. Two, said Dr. Who. Three."), 256))
    assert evaluate.inject(essays, good, sentences).first()["text"] == "One. New. Two, said Dr. Who. Three."


def test_random_texts_round_trip(spark, gaz):
    rng = random.Random(3)
    parts = ["Dmitri", "dmitri falkenberg", "the", "of", "Of Mice and Men", "My cousin Rachel", "a@x.org", "{NAME_1}", "\n\n", ".", ",", "Marie Curie", "Elm Park", "Bank", "’s", "I", "é", "MR", "JO ANN"]
    for _ in range(300):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 25)))
        taken = [("NAME", 1, "{NAME_1}")]
        out, minted, _, _, spans = names.mask(text, taken, Options(), gaz)
        for kind, idx, original in sorted(minted, key=lambda m: -m[1]):
            out = out.replace(f"{{{kind}_{idx}}}", original)
        assert out == text
        assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:]))


def test_words_are_looked_up_once_a_text():
    """What a text costs grows with its distinct words where they begin no name, not with all of them."""
    asked = []

    class Counted(Gazetteer):
        def given(self, token):
            asked.append(token)
            return super().given(token)

        def title_prefix(self, key):
            asked.append(key)
            return super().title_prefix(key)

    gaz = Counted({"ann": names.BIT["given"], "moby dick": names.BIT["title"]})
    text = "it rained on the old town and the wide river all day long. " * 200
    assert masked(text, gaz) == text and len(asked) < 100
    assert masked(text + "then i met ann lee and read moby dick", gaz) == text + "then i met {NAME_1} and read moby dick"


def test_packed_keys_say_what_a_dict_says(spark, monkeypatch):
    """A large gazetteer takes a few buffers at each task, with the same lookups, prefixes of titles included."""
    rows = [(t, k) for t, ks in fixtures.SEED.items() for k in ks] + [("title", f"the {k} of {k % 7}") for k in range(3000)] + [("full", f"élan ’{k}") for k in range(3000)] + [("given", ""), ("other", "x")]
    gazetteer = spark.createDataFrame(rows, "tier string, key string")
    plain = redaction.broadcast(spark, gazetteer).get()
    monkeypatch.setattr(redaction, "MOST_IN_DICT", 10)
    small = redaction.broadcast(spark, gazetteer)
    assert isinstance(small.get().keys, names.PackedKeys) and sum(map(len, small.value.value)) < 60 * (len(plain.keys) + len(plain.prefixes))
    for key in [*plain.keys, *plain.prefixes, "the", "of", "the 5", "élan", "nobody", "", "the 12 of 5 x"]:
        assert small.get().title_prefix(key) == plain.title_prefix(key)
        assert small.get().keys.get(key, 0) & ~names.BEGINS == plain.keys.get(key, 0)
    assert redaction.build(spark, "local", gazetteer, level="identity").gazetteer is None


def test_one_split_is_spread(spark, sf):
    """The identity case takes much work a row, and its table is one small file."""
    from inkveil.queries import queries

    assert queries()["case_identity"](spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
