"""The redaction plans: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import minting
from inkveil.operators import names, structured
from inkveil.operators.names import BEGINS, BIT, Gazetteer, Options, PackedKeys
from inkveil.plans import config

#: Most keys that are broadcast. The published tables have under 400,000.
MOST_KEYS = 4_000_000
#: Most keys that go to the tasks as a dict, which each of an executor's Python processes holds by itself; more are packed.
MOST_IN_DICT = 50_000
SEPARATOR = "\n␞␞␞\n"
#: Rows of a batch that are Python objects at once.
ROWS = 500
#: Characters of a billed unit.
UNIT = 1000
_SPAN = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("tier", pa.string()), ("mask", pa.bool_()), ("reason", pa.string())])
_MINTED = pa.list_(pa.struct([("kind", pa.string()), ("idx", pa.int32()), ("original", pa.string())]))
_RESULT = pa.struct([("text", pa.string()), ("minted", _MINTED), ("n", pa.int32()), ("habit", pa.string()), ("spans", pa.list_(_SPAN))])
RESULT = (
    f"struct<text:string,minted:{minting.MINTED},n:int,habit:string,"
    "spans:array<struct<text:string,start:int,end:int,kind:string,tier:string,mask:boolean,reason:string>>>"
)


class Service(Protocol):
    """A managed redaction service: one call a text. ``action`` is ``NONE`` or says that it intervened; ``outputs`` are the
    parts of the text it returns, none for a text that stays."""

    def apply(self, guardrail_id: str, version: str, source: str, content: str) -> tuple[str, list[str]]: ...


@dataclass
class Broadcast:
    """A gazetteer at the tasks; built once a task process."""

    value: object
    _built: Gazetteer | None = None

    def get(self) -> Gazetteer:
        if self._built is None:
            keys = self.value.value
            self._built = Gazetteer(keys if isinstance(keys, dict) else PackedKeys(*keys))
        return self._built

    def __getstate__(self) -> dict:
        return {"value": self.value, "_built": None}


def key_table(gazetteer: DataFrame) -> DataFrame:
    """``(key, bits)`` from ``gazetteer(tier, key)``."""
    bits = reduce(lambda c, t: c.when(F.col("tier") == t, BIT[t]), BIT, F.when(F.lit(False), 0))
    return gazetteer.select("key", bits.alias("bit")).filter("bit is not null").groupBy("key").agg(F.bit_or("bit").alias("bits"))


def packed(table: DataFrame) -> tuple[bytes, ...]:
    """The arguments of :class:`PackedKeys` from ``table(key, bits)``. Tasks join the keys of a batch, so the driver gets a
    few rows."""
    words = F.split("key", " ")
    begun = table.filter((F.col("bits").bitwiseAND(BIT["title"]) != 0) & (F.size(words) > 1)).select(words.alias("w"))
    begun = begun.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("key"))
    keys = table.select("key", "bits").filter("key is not null").unionByName(begun.select("key", F.lit(BEGINS).alias("bits"))).groupBy("key").agg(F.bit_or("bits").alias("bits"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [k.encode("utf-8", "surrogatepass") for k in batch.column(0).to_pylist()]
            parts = b"".join(raw), np.array([len(x) for x in raw], np.uint32), np.array([crc32(x) for x in raw], np.uint32), batch.column(1).to_numpy().astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in parts], names=["blob", "lengths", "sums", "bits"])

    rows = list(keys.mapInArrow(join, "blob binary, lengths binary, sums binary, bits binary").toLocalIterator())
    whole = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
    return PackedKeys.pack(b"".join(r["blob"] for r in rows), whole("lengths", np.uint32), whole("sums", np.uint32), whole("bits", np.uint8))


def broadcast(spark: SparkSession, gazetteer: DataFrame) -> Broadcast | None:
    """The keys at the tasks; None, before any is brought to the driver, where there are more than ``MOST_KEYS``."""
    table = key_table(gazetteer)
    n = table.limit(MOST_KEYS + 1).count()
    if n > MOST_KEYS:
        return None
    return Broadcast(spark.sparkContext.broadcast(packed(table) if n > MOST_IN_DICT else {r["key"]: r["bits"] for r in table.toLocalIterator()}))


def _mask_udf(options: Options, source: Broadcast | None, own_keys: bool = False):
    @F.arrow_udf(RESULT)
    def run(text: pa.Array, minted: pa.Array, keep: pa.Array, own: pa.Array) -> pa.Array:
        shared = source.get() if source else None
        pieces = [pa.array([], _RESULT)]
        for at in range(0, len(text), ROWS):
            out = []
            for t, m, k, o in zip(*(x.slice(at, ROWS).to_pylist() for x in (text, minted, keep, own))):
                gaz = Gazetteer(dict(o or ())) if own_keys else shared
                masked, new, n, habit, spans = names.mask(t, [(x["kind"], x["idx"], x["original"]) for x in m], options, gaz, frozenset(k or ()))
                out.append({"text": masked, "minted": [{"kind": a, "idx": i, "original": b} for a, i, b in new], "n": n, "habit": habit, "spans": spans})
            pieces.append(pa.array(out, _RESULT))
        return pa.concat_arrays(pieces)

    # Else the optimizer may move the call into the lambda of a later column, where no Python function can run.
    return run.asNondeterministic()


def keys_of(text: str) -> list[str]:
    """Every key that the scan of a text could look up: folded runs of up to eight tokens, and whole candidates."""
    tokens = [(m.start(), m.end()) for m in names._TOKEN.finditer(text)]
    out = {names.fold(text[tokens[k][0] : tokens[k + n][1]]) for k in range(len(tokens)) for n in range(min(names.MOST_TITLE, len(tokens) - k))}
    out |= {names.fold(text[a:b]) for a, b, _ in names.Scan(text, Options(), None).candidates()}
    return sorted(out - {""})


def with_own_keys(docs: DataFrame, text: Column, table: DataFrame) -> DataFrame:
    """``docs`` with ``__own``: of ``table(key, bits)`` what each text could look up, by a join on the key.

    What a text looks up depends on it alone, so its entries come back by a hash of it, and no row needs a number. Texts
    whose hashes collide get each other's entries too, which they don't look up. Copies of a text are asked for once.
    """

    @F.arrow_udf("array<string>")
    def keys(t: pa.Array) -> pa.Array:
        return pa.array([keys_of(x or "") for x in t.to_pylist()], pa.list_(pa.string()))

    texts = docs.select(text.alias("__t")).groupBy(F.xxhash64("__t").alias("__hash"), "__t").agg(F.count("*")).select("__hash", "__t")
    wanted = texts.select("__hash", F.explode(keys.asNondeterministic()(F.col("__t"))).alias("key"))
    found = wanted.join(table, "key").groupBy("__hash").agg(F.map_from_entries(F.collect_set(F.struct("key", "bits"))).alias("__own"))
    return docs.withColumn("__text_hash", F.xxhash64(text)).join(found, F.col("__text_hash") == F.col("__hash"), "left").drop("__text_hash", "__hash")


@dataclass(frozen=True)
class Redactor:
    """What one configuration does to tables of documents.

    ``redact`` adds ``masked_text, n_masked, intervened, char_units, restore_map, habit, spans``. Null text stays null with
    nothing masked; empty text stays empty. Restore maps are personal data: write them apart from the masked text.
    """

    mode: str
    options: Options
    outbound_options: Options
    gazetteer: Broadcast | None = None
    #: ``(key, bits)`` of a gazetteer that is too large to broadcast: each document then gets its own entries by a join.
    table: DataFrame | None = None
    #: What makes a client of the managed service in each task, with the rule set's id and version.
    client: Callable[[], Service] | None = None
    service_id: str = ""
    service_version: str = "DRAFT"

    def _served(self, text: Column, source: str) -> Column:
        """``(text, intervened)`` from the service, a call a text that isn't blank."""
        make, name, version = self.client, self.service_id, self.service_version

        @F.arrow_udf("struct<text:string,intervened:boolean>")
        def run(batch: pa.Array) -> pa.Array:
            client, out = make(), []
            for t in batch.to_pylist():
                action, outputs = client.apply(name, version, source, t) if t.strip() else ("NONE", [])
                out.append({"text": "".join(outputs) if action != "NONE" and outputs else t, "intervened": action != "NONE"})
            return pa.array(out, pa.struct([("text", pa.string()), ("intervened", pa.bool_())]))

        return run.asNondeterministic()(text)

    def _run(self, docs: DataFrame, text_col: str, identity_col: str | None, keep: Column | None, options: Options, source: str = "INPUT") -> DataFrame:
        cols = [F.col(f"`{c}`") for c in docs.columns]
        text, absent = F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()
        if self.mode == config.STUB:
            out = docs.withColumn("__text", structured.stub(text))
            changed = F.col("__text") != text
            return out.select(
                *cols, F.when(~absent, F.col("__text")).alias("masked_text"), F.lit(None).cast("int").alias("n_masked"), changed.alias("intervened"), F.lit(0).alias("char_units"),
                F.lit(None).cast("map<string,string>").alias("restore_map"), F.lit(None).cast("string").alias("habit"), F.array().cast(_spans_type()).alias("spans"),
            )
        if self.mode == config.SERVICE:
            out = docs.withColumn("__served", self._served(text, source))
            units = F.ceil(F.length(text) / UNIT).cast("int")
            return out.select(
                *cols, F.when(~absent, F.col("__served.text")).alias("masked_text"), F.lit(None).cast("int").alias("n_masked"), F.col("__served.intervened").alias("intervened"), units.alias("char_units"),
                F.lit(None).cast("map<string,string>").alias("restore_map"), F.lit(None).cast("string").alias("habit"), F.array().cast(_spans_type()).alias("spans"),
            )
        out = structured.with_state(docs, text, None if identity_col is None else F.col(identity_col), options.numbered)
        s = F.col("__state")
        if options.level == config.IDENTITY or (self.gazetteer is None and self.table is None):
            new = F.struct(s["text"].alias("text"), s["minted"].alias("minted"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("habit"), F.array().cast(_spans_type()).alias("spans"))
        else:
            kept = F.array().cast("array<string>") if keep is None else keep
            own = F.lit(None).cast("map<string,int>")
            if self.table is not None:
                out, own = with_own_keys(out, s["text"], self.table), F.col("__own")
            new = _mask_udf(options, self.gazetteer, self.table is not None)(s["text"], s["minted"], kept, own)
        out = out.withColumn("__new", new)
        r = F.col("__new")
        n = s["n"] + r["n"]
        restored = minting.restore_map(r["minted"]) if options.numbered else F.lit(None).cast("map<string,string>")
        return out.select(
            *cols, F.when(~absent, r["text"]).alias("masked_text"), n.alias("n_masked"), (n > 0).alias("intervened"), F.lit(0).alias("char_units"),
            restored.alias("restore_map"), r["habit"].alias("habit"), r["spans"].alias("spans"),
        )

    def redact_inbound(self, docs: DataFrame, text_col: str = "text", identity_col: str | None = None) -> DataFrame:
        return self._run(docs, text_col, identity_col, None, self.options)

    def carried(self, docs: DataFrame, text_col: str = "text", identity_col: str | None = None) -> DataFrame:
        """``docs`` with ``__keep``: the words of each document that its feedback may repeat."""
        source, options, joined = self.gazetteer, self.options, self.table is not None
        text = F.coalesce(F.col(text_col), F.lit(""))

        @F.arrow_udf("array<string>")
        def run(text: pa.Array, names_of: pa.Array, own: pa.Array) -> pa.Array:
            shared = source.get() if source else None
            out = []
            for t, ns, o in zip(text.to_pylist(), names_of.to_pylist(), own.to_pylist()):
                gaz = Gazetteer(dict(o or ())) if joined else shared
                out.append(sorted(names.carried_keeps(t, options, gaz, [n for n in ns or [] if n])))
            return pa.array(out, pa.list_(pa.string()))

        i = None if identity_col is None else F.col(identity_col)
        writer = F.array().cast("array<string>") if i is None else F.concat(F.array(i["first_name"], i["last_name"]), F.coalesce(i["extra_names"], F.array().cast("array<string>")))
        with_keys = with_own_keys(docs, text, self.table) if joined else docs.withColumn("__own", F.lit(None).cast("map<string,int>"))
        return with_keys.withColumn("__keep", run.asNondeterministic()(text, writer, F.col("__own"))).drop("__own")

    def redact_outbound(self, feedback: DataFrame, essays: DataFrame, on: str = "doc_id", text_col: str = "text", identity_col: str | None = None) -> DataFrame:
        """Feedback with the keeps of its essay carried over: one equality join on ``on``, of ids and short word lists."""
        keeps = self.carried(essays, text_col, identity_col).select(F.col(on).alias("__on"), "__keep", *([] if identity_col is None else [F.col(identity_col).alias("__who")]))
        joined = feedback.join(keeps, feedback[on] == keeps["__on"], "left")
        out = self._run(joined, text_col, None if identity_col is None else "__who", F.col("__keep"), self.outbound_options, "OUTPUT")
        return out.drop("__on", "__keep", "__who")

    def redact_outbound_batch(self, feedback: DataFrame, on: str = "doc_id", order: str = "field_no", text_col: str = "text") -> DataFrame:
        """``(on, order, masked_text, batched)``: a document's fields joined, masked once, and split again; if a field
        holds the separator itself, field by field. Fields share their numbering; empty ones are left out of the joint text."""
        some = F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0
        fields = feedback.filter(some).groupBy(on).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))).alias("fields"))
        joint = fields.withColumn("__joint", F.array_join(F.transform("fields", lambda f: f["t"]), SEPARATOR))
        # A joint text that doesn't split into its fields is known beforehand, so each text is masked once, jointly or field
        # by field. Masks don't reach over the separator: no pattern matches its marks.
        split = lambda t: F.split(t, SEPARATOR, -1)
        whole = split(F.col("__joint")) == F.transform("fields", lambda f: f["t"])
        units = joint.select(on, F.explode(F.when(whole, F.array(F.struct(F.lit(None).cast(feedback.schema[order].dataType).alias("o"), F.col("__joint").alias("t"), F.col("fields").alias("fields")))).otherwise(
            F.transform("fields", lambda f: F.struct(f["o"].alias("o"), f["t"].alias("t"), F.array(f).alias("fields")))
        )).alias("u"), whole.alias("batched")).select(on, "batched", F.col("u.o").alias("o"), F.col("u.t").alias("__t"), F.col("u.fields").alias("fields"))
        masked = self._run(units, "__t", None, None, self.outbound_options, "OUTPUT")
        parts = F.when(F.col("batched"), split(F.col("masked_text"))).otherwise(F.array("masked_text"))
        lost = F.size(parts) != F.size("fields")
        checked = F.when(lost, F.raise_error(F.lit("a separator was masked"))).otherwise(parts)
        rows = masked.select(on, "batched", F.posexplode(F.arrays_zip("fields", checked.alias("parts"))).alias("i", "x"))
        done = rows.select(on, F.col("x.fields.o").alias(order), F.col("x.parts").alias("masked_text"), "batched")
        empty = feedback.filter(~some).select(on, order, F.col(text_col).alias("masked_text"), F.lit(True).alias("batched"))
        return done.unionByName(empty)


def _spans_type() -> str:
    return "array<struct<text:string,start:int,end:int,kind:string,tier:string,mask:boolean,reason:string>>"


def build(spark: SparkSession, value: bool | str | None = None, gazetteer: DataFrame | None = None, level: str | None = None, outbound: str | None = None, options: Options | None = None, client: Callable[[], Service] | None = None, service_id: str = "", service_version: str = "DRAFT") -> Redactor | None:
    """A redactor for the configured mode; None where redaction is off. The managed service is reached through ``client``,
    which the host brings; without one its mode raises."""
    mode = config.mode(value)
    if mode == config.OFF:
        return None
    if mode == config.SERVICE:
        if client is None:
            raise ValueError("the managed service needs a client; use the local or stub mode without one")
        return Redactor(mode, Options(level=config.IDENTITY), Options(level=config.IDENTITY), client=client, service_id=service_id, service_version=service_version)
    inbound = config.level(level)
    base = options or Options()
    names_at = table = None
    levels = {inbound, config.outbound_level(outbound, inbound)}
    if gazetteer is not None and mode == config.LOCAL and levels != {config.IDENTITY}:  # at that level no key is looked up
        names_at = broadcast(spark, gazetteer)
        table = key_table(gazetteer) if names_at is None else None
    return Redactor(mode, replace(base, level=inbound), replace(base, level=config.outbound_level(outbound, inbound)), names_at, table)


def transform(redactor: Redactor | None, **kw) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``: the identity where redaction is off."""
    return (lambda df: df) if redactor is None else lambda df: redactor.redact_inbound(df, **kw)
