"""Web archives: pages written as WARC records, monolithic gzip files normalised to a member for each record, and read back by an index.

Three passes. `write` puts every page as a response into archives that are one gzip stream each, as captures often are, and notes each
record's place and payload digest. `duplicates` decides from these notes alone which records repeat a payload. `normalise` inflates each archive once, as a
stream, writes every record as a gzip member of its own, a repeat as a revisit without its payload, and beside it a sidecar index with each
member's place, so that any record can then be read alone (`members`, `read`).

Texts are never shuffled. Files are written from tasks through pyarrow's file systems (file, hdfs, s3, gs, abfs) under names that no other attempt of a task
uses; those that count are the ones a committed table names, so lost and repeated tasks leave files that nothing reads. An archive closes
beyond RECORDS records or BYTES of payload, which bounds what one task rewrites.

Pages: null html is an empty payload; a null url has no target; a null page_id is smaller than any other and is null again where it is read. Rows that agree in
page_id and payload are records of their own: one of them is the response, if none has a larger id, and the others refer to that id. No pages, no
archives. Other columns are ignored. An archive that breaks off, or isn't made of WARC records, is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import looked_up, materialise, shared_dir, tidy_batches

#: An archive's most records, and payload bytes after which it closes.
RECORDS, BYTES = 20_000, 128 << 20
#: Payloads with fewer bytes are never revisits.
LEAST = 1000
#: Bytes of an archive that a task reads in one go.
STRIPE = 16 << 20
PIECE = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri))
    try:
        return pa.fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"archives can't be kept in {uri.split(':')[0]}: set spark.checkpoint.dir to a file, hdfs, s3, gs or abfs folder") from e


# ---- records


def lines(fields: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)


def one_line(text: str) -> str:
    """A header's value: what would end the line or is no character of its own is escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def sha1_hex(label: str) -> str:
    return base64.b32decode(label.partition(":")[2]).hex()


def response(page_id: int | None, url: str | None, payload: bytes, record_id: str, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\n" + lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", one_line(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields += [("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest())), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return VERSION + b"\r\n" + lines(fields) + b"\r\n" + http + payload + END


class Block:
    """A record's block, read in pieces; `rest` leaves the stream at its end."""

    def __init__(self, stream: BinaryIO, length: int):
        self.stream, self.left = stream, length

    def read(self, most: int = PIECE) -> bytes:
        out = self.stream.read(min(most, self.left))
        if self.left and not out:
            raise EOFError("an archive breaks off within a record")
        self.left -= len(out)
        return out

    def line(self) -> bytes:
        out = self.stream.readline(self.left)
        self.left -= len(out)
        return out

    def rest(self) -> None:
        while self.left:
            self.read()


def records(stream: BinaryIO) -> Iterator[tuple[bytes, list[tuple[str, str]], Block]]:
    """Version line, fields and block of each record of an inflated stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: list[tuple[str, str]] = []
        while (field := stream.readline()).strip():
            name, _, value = field.decode("utf-8", "replace").partition(":")
            if field[:1] in b" \t" and fields:  # a folded line
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {field.decode('utf-8', 'replace').strip()}")
            else:
                fields.append((name.strip(), value.strip()))
        if not field:
            raise EOFError("an archive breaks off within a header")
        block = Block(stream, int(field_of(fields, "Content-Length", "0")))
        yield line.strip(), fields, block
        block.rest()


def field_of(fields: list[tuple[str, str]], name: str, otherwise: str | None = None) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), otherwise)


def inflated(raw: Any) -> BinaryIO:
    """A stream of an archive's bytes, whether it is one gzip member, many, or not compressed at all."""
    raw = io.BufferedReader(raw, PIECE)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), PIECE) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


# ---- writing


class Archive:
    """One gzip stream of records, under a name of its own."""

    def __init__(self, folder: str):
        self.name = uuid.uuid4().hex
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        self.file, self.size, self.count = f"{folder}/{self.name}.warc.gz", 0, 0
        self.out, self.gzip = fs.open_output_stream(f"{path}/{self.name}.warc.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)

    def add(self, record: bytes) -> None:
        self.out.write(self.gzip.compress(record))
        self.size, self.count = self.size + len(record), self.count + 1

    def close(self) -> None:
        self.out.write(self.gzip.flush())
        self.out.close()


NOTES = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("id", pa.string()), ("page_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.binary())])


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most: int = RECORDS, size: int = BYTES) -> DataFrame:
    """A table of the records written: file, ordinal within it, id, page_id, n_bytes and sha256 of the payload. Where pages are read, they are written."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.column("page_id"), batch.column("url"), batch.column("html"), strict=True):
                if archive and (archive.count >= most or archive.size >= size):
                    archive.close()
                    archive = None
                archive = archive or Archive(folder)
                payload = (html.as_py() or "").encode()
                known = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{archive.name}/{archive.count}"))
                rows.append((archive.file, archive.count, known, page.as_py(), len(payload), hashlib.sha256(payload).digest()))
                archive.add(response(page.as_py(), url.as_py(), payload, known, date))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NOTES.types, strict=True)], schema=NOTES)
        if archive:
            archive.close()

    notes = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "file string, ordinal long, id string, page_id long, n_bytes long, sha256 binary")
    return materialise(notes, "warc-notes")


def duplicates(notes: DataFrame, least: int = LEAST) -> DataFrame:
    """file, ordinal and refers (a record's id) of each record whose payload, of at least so many bytes, a record with a larger page_id has too."""
    key = ["sha256", "n_bytes"]
    large = notes.filter(F.col("n_bytes") >= least)
    last = large.groupBy(*key).agg(F.max(F.struct("page_id", "file", "ordinal", "id")).alias("last"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    found = looked_up(large.select("file", "ordinal", *key), last, key)
    return found.filter("last IS NOT NULL AND NOT (file = last.file AND ordinal = last.ordinal)").select("file", "ordinal", F.col("last.id").alias("refers"))


# ---- normalising


def member(out: Any, parts: Iterator[bytes]) -> int:
    """Writes one gzip member; its length."""
    squeezed, n = zlib.compressobj(6, zlib.DEFLATED, 31), 0
    for part in parts:
        n += out.write(squeezed.compress(part))
    return n + out.write(squeezed.flush())


def as_it_is(version: bytes, fields: list[tuple[str, str]], block: Block) -> Iterator[bytes]:
    yield version + b"\r\n" + lines(fields) + b"\r\n"
    while block.left:
        yield block.read()
    yield END


def as_revisit(version: bytes, fields: list[tuple[str, str]], block: Block, refers: str) -> Iterator[bytes]:
    """Only the HTTP header is left of the block."""
    http = b""
    while block.left and (line := block.line()).strip():
        http += line
    http += b"\r\n"
    kept = [(k, v) for k, v in fields if k.lower() not in ("warc-type", "content-length", "warc-block-digest", "warc-profile", "warc-refers-to")]
    yield version + b"\r\n" + lines([("WARC-Type", "revisit"), *kept, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers}>"), ("Content-Length", str(len(http)))]) + b"\r\n"
    yield http + END


def rewrite(source: str, target: str, revisits: dict[int, str]) -> int:
    """Writes target (an archive with a member for each record) and its sidecar index from source; the number of records.

    revisits: ordinal of a record -> id of the record that has its payload. A source is inflated once; a record passes in pieces.
    """
    (fs, path), (to, there) = store(source), store(target)
    at = ordinal = 0
    with fs.open_input_stream(path, compression=None) as raw, to.open_output_stream(there, compression=None) as out, to.open_output_stream(f"{there}.idx", compression=None) as index:
        for ordinal, (version, fields, block) in enumerate(records(inflated(raw)), 1):
            refers = revisits.get(ordinal - 1)
            n = member(out, as_it_is(version, fields, block) if refers is None else as_revisit(version, fields, block, refers))
            kind = "revisit" if refers is not None else field_of(fields, "WARC-Type")
            line = {"offset": at, "length": n, "type": kind, "id": field_of(fields, "WARC-Record-ID"), "uri": field_of(fields, "WARC-Target-URI")}
            index.write(json.dumps(line).encode() + b"\n")
            at += n
    return ordinal


def normalise(archives: DataFrame, folder: str, revisits: DataFrame | None = None) -> DataFrame:
    """A table of archives with a member for each record, beside each of which is its index: file, n_records and source.

    archives: file, one row each. revisits: of `duplicates`. One archive is one piece of work; its revisits are bounded by its records.
    """
    spark = archives.sparkSession
    known = archives.select("file")
    if revisits is None:
        known = known.withColumn("revisits", F.lit(None).cast("array<struct<ordinal: long, refers: string>>"))
    else:
        known = known.join(revisits.groupBy("file").agg(F.collect_list(F.struct("ordinal", "refers")).alias("revisits")), "file", "left")
    known = materialise(known, "warc-work")
    n = max(1, known.count())
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, found in zip(batch.column("file").to_pylist(), batch.column("revisits"), strict=True):
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                count = rewrite(file, target, {r["ordinal"]: r["refers"] for r in found.as_py() or []})
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (target, count, file)], names=["file", "n_records", "source"])

    # as many tasks as archives, whose rows say nothing about their size
    spread = known.repartition(n)
    return materialise(spread.mapInArrow(run, "file string, n_records long, source string"), "warc-archives")


# ---- reading


MEMBERS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string())])


def members(archives: DataFrame) -> DataFrame:
    """The index of normalised archives as rows: file, offset, length, type, id and uri of each record."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = store(f"{file}.idx")
                with fs.open_input_stream(path, compression=None) as raw:
                    rows = [{"file": file} | json.loads(line) for line in io.BufferedReader(raw, PIECE)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema=MEMBERS)

    return archives.select("file").mapInArrow(run, "file string, offset long, length long, type string, id string, uri string")


def opened(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Fields and payload of the record in a member."""
    _, fields, block = next(records(io.BytesIO(zlib.decompress(data, 31))))
    body = b""
    while block.left:
        body += block.read()
    if (field_of(fields, "Content-Type") or "").startswith("application/http"):
        body = body.partition(END)[2]
    return fields, body


FOUND = [("id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("refers", pa.string())]


def read(found: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of `members`: id, type, page_id, n_bytes and digest (SHA-1, hex) of the payload, refers and, if asked for, payload.

    A revisit has the digest that it names and no bytes. Members are fetched by their place, those of a stretch of an archive in one task.
    """
    schema = pa.schema([*FOUND, *([("payload", pa.binary())] if with_payload else [])])

    def parsed(data: bytes) -> tuple:
        fields, body = opened(data)
        number, refers, kind = field_of(fields, "X-Page-ID"), field_of(fields, "WARC-Refers-To"), field_of(fields, "WARC-Type")
        revisit = kind == "revisit"
        digest = sha1_hex(field_of(fields, "WARC-Payload-Digest")) if revisit else hashlib.sha1(body).hexdigest()
        return (field_of(fields, "WARC-Record-ID"), kind, None if number is None else int(number), None if revisit else len(body), digest, refers, *([None if revisit else body] if with_payload else []))

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if source:
                        source.close()
                    fs, path = store(file)
                    name, source = file, fs.open_input_file(path)
                rows.append(parsed(source.read_at(length, offset)))
                held += len(rows[-1][-1] or b"") if with_payload else 0
                if held > 16 * PIECE:
                    yield batch_of(rows, schema)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, schema)
        if source:
            source.close()

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    stretch = F.floor(F.col("offset") / STRIPE)
    spread = found.select("file", "offset", "length").repartition(n, F.col("file"), stretch).sortWithinPartitions("file", "offset")
    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return spread.mapInArrow(run, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def resolved(found: DataFrame) -> DataFrame:
    """What `read` gives, with refers_to (the page_id of the response that a revisit names) and that response's n_bytes."""
    revisits = found.filter("type = 'revisit'").drop("n_bytes")
    responses = found.filter("type = 'response'")
    known = responses.select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), "n_bytes")
    return looked_up(revisits, known, ["refers"]).unionByName(responses.withColumn("refers_to", F.lit(None).cast("long")))


def archived(pages: DataFrame, folder: Callable[[SparkSession], str] | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of pages, as their archives have them after all three passes."""
    spark = pages.sparkSession
    where = folder(spark) if folder else f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    notes = write(pages, f"{where}/raw")
    archives = normalise(notes.select("file").distinct(), f"{where}/records", duplicates(notes))
    out = resolved(materialise(read(members(archives)), "warc-records"))
    return out.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
