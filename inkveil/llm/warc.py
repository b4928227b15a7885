"""WARC archives of pages, compressed record by record with a Zstandard dictionary.

A file starts with a skippable frame (magic ``0x184D2A5D``) that holds the dictionary, itself a Zstandard frame; every
record after it is a frame of its own, compressed with that dictionary. Each task trains it from the first records of
its file, up to ``TRAIN_BYTES`` of them, then streams the rest; a file ends at ``FILE_BYTES`` of records. Files get a
name no other attempt uses, and only those that finished attempts report are listed, so retried and speculative tasks
leave no record twice.

Of records with equal payloads of ``LEAST_BYTES`` or more, the one with the least page_id is the response and the rest
revisit it. Digests, not payloads, are grouped; the payload moves once at most, by page, so copies of one page, however
many, meet in no task.

Defined results. Null html: an empty payload. Null url: no target URI. A url comes back as it was, escapes and all:
where it holds what a header can't, a second field keeps the original. Null page_id: its record has no id field; with a
payload that others have it revisits them, if they have an id. Rows that repeat the least page_id of a payload are all
responses. Reading checks each payload's SHA-256 against its record and raises if they differ. Empty table: no files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import drop_stored, new_path, partitions, stored

LEAST_BYTES = 100
#: Bounds: bytes of records a dictionary is trained from, its size, and bytes of records in a file.
TRAIN_BYTES, DICT_BYTES, FILE_BYTES = 2 << 20, 64 << 10, 256 << 20
LEVEL = 6
MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
_URI = "!#$%&'()*+,/:;=?@[]~"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}' if page_id is not None else f'none {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record."""
    head = _HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        uri = quote(url, safe=_URI, errors="surrogatepass")
        fields.append(("WARC-Target-URI", uri))
        if uri != url:  # what can't stand in a header is escaped; as escapes of its own stay, the way back isn't certain
            fields.append(("WARC-X-Target", quote(url, safe="", errors="surrogatepass")))
    if page_id is not None:
        fields.append(("WARC-X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, None)), ("WARC-X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class Writer:
    """One archive file. Records are held until there are enough to train the dictionary."""

    def __init__(self, path: str):
        self.path, self.held, self.size, self.n, self.stream, self.codec = path, [], 0, 0, None, None

    def _open(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, self.held, level=LEVEL)
        except zstandard.ZstdError:  # too few or too like records: their own bytes are the dictionary
            trained = zstandard.ZstdCompressionDict(b"".join(self.held)[:DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = trained.as_bytes()
        frame = zstandard.ZstdCompressor(level=19).compress(raw)
        fs, path = open_fs(self.path)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(path, compression=None)  # else it compresses by the name
        self.stream.write(struct.pack("<II", MAGIC, len(frame)) + frame)
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        for r in self.held:
            self.stream.write(self.codec.compress(r))
        self.held = []

    def add(self, r: bytes) -> None:
        self.size += len(r)
        self.n += 1
        if self.stream:
            self.stream.write(self.codec.compress(r))
            return
        self.held.append(r)
        if self.size >= TRAIN_BYTES:
            self._open()

    def close(self) -> tuple[str, int, int]:
        if not self.stream:
            self._open()
        self.stream.close()
        return self.path, self.n, self.size


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            page, url, payload, digest, refers = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                writer = writer or Writer(f"{root}/{uuid.uuid4().hex}.warc.zst")
                writer.add(record(page[k].as_py(), url[k].as_py(), payload[k].as_py(), digest[k].as_py(), refers[k].as_py()))
                if writer.size >= FILE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(3)], names=["file", "n_records", "n_bytes"])

    return run


def write(pages: DataFrame, root: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``root``; returns the stored list ``(file, n_records, n_bytes)``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    digests = stored(base.filter(F.octet_length("payload") >= LEAST_BYTES).select("page_id", "digest"), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = digests.join(first, "digest").filter("page_id > first or page_id is null").select(F.col("page_id").alias("later"), "digest", "first").distinct()
    rows = base.join(later.withColumnRenamed("digest", "same"), F.col("page_id").eqNullSafe(F.col("later")) & (F.col("digest") == F.col("same")), "left")
    laid = rows.select("page_id", "url", "payload", "digest", "first")
    listed = stored(laid.mapInArrow(_write(root), "file string, n_records bigint, n_bytes bigint"), "archives")
    drop_stored(digests)
    return listed


def records(file: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: header fields and block, one at a time."""
    fs, path = open_fs(file)
    with fs.open_input_stream(path, compression=None) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != MAGIC:
            raise ValueError(f"{file}: no dictionary frame")
        raw = zstandard.ZstdDecompressor().decompress(stream.read(size))
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        with codec.stream_reader(stream, read_across_frames=True) as plain:
            held = b""
            while True:
                while (end := held.find(b"\r\n\r\n")) < 0:
                    more = plain.read(1 << 16)
                    if not more:
                        if held:
                            raise ValueError(f"{file}: cut short")
                        return
                    held += more
                lines = held[:end].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"{file}: {lines[0]!r} is no record")
                fields = dict(line.split(": ", 1) for line in lines[1:])
                need = end + 4 + int(fields["Content-Length"]) + 4
                parts, have = [held], len(held)
                while have < need:
                    more = plain.read(max(1 << 16, need - have))
                    if not more:
                        raise ValueError(f"{file}: cut short")
                    parts.append(more)
                    have += len(more)
                held = b"".join(parts)
                yield fields, held[end + 4 : need - 4]
                held = held[need:]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    for batch in batches:
        for file, n_records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, size, n = [], 0, 0
            for fields, block in records(file):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file}: payload of {fields['WARC-Record-ID']} doesn't match its digest")
                length = int(head.rpartition(b"Content-Length: ")[2])
                integer = lambda name: int(fields[name]) if name in fields else None  # noqa: E731, B023
                url = unquote(fields["WARC-X-Target"], errors="surrogatepass") if "WARC-X-Target" in fields else fields.get("WARC-Target-URI")
                rows.append((integer("WARC-X-Page-ID"), url, length, digest, kind, integer("WARC-X-Refers-To-Page-ID"), payload if kind == "response" else None))
                size += len(block)
                n += 1
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
            if n != n_records:  # a file cut inside a frame ends early
                raise ValueError(f"{file}: {n} records, {n_records} were written")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read(files: DataFrame) -> DataFrame:
    """The records of the archives in ``files(file, n_records)``, payloads of responses included; a task takes one file at a time."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return files.select("file", "n_records").repartition(partitions(files.sparkSession), "file").mapInArrow(_read, schema)


def compared(pages: DataFrame) -> DataFrame:
    """The columns that the query op9 returns: written, and read back."""
    root = new_path(pages.sparkSession, "warc")
    return read(write(pages, root)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
