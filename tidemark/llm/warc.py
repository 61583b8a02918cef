"""Legacy archive conversion: ARC files in, equivalent WARC files out, and a reader of either.

An ARC file begins with a version block (`filedesc://`), whose second line gives the version: version 1 headers are
`URL IP date type length`, version 2 headers are `URL IP date type status checksum location offset file length`. Each
record is its header line, as many bytes as its length says, and a line feed. The converter parses that by declared
lengths, never by searching payloads, and synthesises for every record a WARC identifier (a name-based UUID), the
ISO timestamp, the type and the SHA-1 digests. Of records with equal payloads of at least `least_bytes`, that with the
largest key stays a response and the others become revisits that refer to it.

An archive has about `archive_bytes` of records (one at least). It is one row of Spark's text writer (gzip, one row to a
file), so output files go through the task commit protocol to any file system Spark can write, and are read with
`binaryFile`, one archive at a time, unpacked as a stream. An archive is one gzip member, since that writer packs whole
files. Only digests, keys and places are shuffled to find revisits. They are a written table, which payloads meet in
place if it is small enough to broadcast, by a shuffle otherwise.

A record's identifier comes from its key, its URL and its place in the archives, so repeated rows have their own.

Defined results: a null payload is empty; null URLs are `urn:page:<key>`; spaces, control characters and all bytes above
ASCII in URLs are percent-encoded; of equal payloads whose largest key occurs in several rows all of these are
responses; null keys are the smallest; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, materialise

_ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"],
}
#: What ends a WARC record; an ARC record ends with one line feed.
WARC_END, ARC_END = "\r\n\r\n", "\n"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")
#: Field of the archived HTTP head that holds the row's key.
KEY_FIELD = "X-Archive-Key"
#: Bytes of records after which an archive ends.
ARCHIVE_BYTES = 32_000_000


def record_id(key: str | None, url: str, file: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key} {url} {file} {number}')}>"


def timestamp(date: str) -> str:
    """YYYYMMDDhhmmss of an ARC header as a WARC date; missing digits are those of the earliest moment."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest_field(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _escaped(url: str) -> str:
    """A URL in ASCII, as an archive's header line needs it."""
    return "".join(f"%{b:02X}" if b <= 0x20 or b >= 0x7F else chr(b) for b in url.encode())


# --- ARC ---


def arc_version_block(version: int) -> str:
    body = f"{version} 0 tidemark\n{' '.join(_ARC_FIELDS[version])}\n"
    tail = f"200 - - 0 pages.arc {len(body)}" if version == 2 else f"{len(body)}"
    return f"filedesc://pages.arc 0.0.0.0 19961001000000 text/plain {tail}\n{body}"


def arc_record(version: int, key: str, url: str | None, payload: str) -> str:
    """An ARC record without its last line feed: header line, HTTP head and payload."""
    size = len(payload.encode())
    block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n{KEY_FIELD}: {key}\r\n\r\n"
    url = _escaped(url) if url else f"urn:page:{key}"
    tail = f"200 - - 0 pages.arc {len(block) + size}" if version == 2 else f"{len(block) + size}"
    return f"{url} 0.0.0.0 19961001000000 text/html {tail}\n{block}{payload}"


def read_arc(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an ARC file, without its version blocks: header fields by the version's names, and the block."""
    fields = _ARC_FIELDS[1]
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if values[0].startswith("filedesc://"):
            body = stream.read(int(values[-1]))
            fields = _ARC_FIELDS[int(body.split(b" ", 1)[0])]
            continue
        if len(values) != len(fields):
            raise ValueError(f"an ARC header of {len(values)} fields where the version has {len(fields)}: {line[:200]!r}")
        got = dict(zip(fields, values))
        length = int(got["length"])
        got["block"] = stream.read(length)
        if len(got["block"]) != length:
            raise ValueError(f"an ARC record of {len(got['block'])} bytes; its header says {length}")
        yield got


# --- WARC ---


def _head(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its empty line, and payload."""
    head, line, payload = block.partition(b"\r\n\r\n")
    return head + line, payload


def _field(head: bytes, name: str) -> str | None:
    wanted = name.lower().encode() + b":"
    for line in head.split(b"\r\n"):
        if line.lower().startswith(wanted):
            return line[len(wanted) :].strip().decode("utf-8", "replace")
    return None


def warc_record(kind: str, rid: str, url: str, ip: str, date: str, head: str, payload: str, digest: str, refers_to: str | None) -> str:
    """A WARC record without its last two line breaks; a revisit has the HTTP head only."""
    block = head if kind == "revisit" else head + payload
    raw = block.encode()
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    lines += [f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {digest_field(hashlib.sha1(raw).digest())}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def warcinfo(name: str, date: str) -> str:
    """The record at an archive's beginning, without its last two line breaks."""
    body = "software: tidemark\r\nformat: WARC File Format 1.0\r\n"
    lines = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + body


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"a WARC record of {len(block)} bytes; its header says {length}")
        yield fields, block


# --- Spark ---


def _unpacked(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): file is the archive's name without what differs from run to run."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "").alias("file"), "content")


def _archives(records: Iterable[str], end: str, head: Callable[[int], str], most: int) -> Iterator[pa.RecordBatch]:
    """Records, each followed by `end`, as archives of about `most` bytes, one row to a batch; head(n) begins the n-th. A row leaves out its last end."""
    held, size, n = [], 0, 0
    for record in records:
        if not held:
            held, n = [head(n)], n + 1
        held.append(record)
        size += len(record)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.large_string()).cast(pa.string())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([end.join(held)])], names=["value"])


def _write(rows: DataFrame, end: str, path: str) -> None:
    rows.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about `most` bytes of their strings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes))) + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages as ARC files in path, each with its version block: those of every other task are of version 2, the rest of version 1."""
    rows = pages.select(F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"), F.spark_partition_id().alias("task"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1

        def records() -> Iterator[str]:
            nonlocal version
            for b in batches:
                for key, url, payload, task in zip(*(c.to_pylist() for c in b.columns)):
                    version = 1 + task % 2
                    yield arc_record(version, key, url, payload)

        yield from _archives(records(), ARC_END, lambda n: arc_version_block(version).removesuffix("\n"), archive_bytes)

    _write(rows.mapInArrow(run, "value string"), ARC_END, path)


def arc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(file, number, key, url, ip, date, head, sha1, payload_bytes) of every record of the ARC files in path, and its payload if asked for; number counts a file's records."""
    schema = pa.schema([("file", pa.string()), ("number", pa.int32()), ("key", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("head", pa.string()), ("sha1", pa.binary()), ("payload_bytes", pa.int64())] + [("payload", pa.binary())] * payloads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                    for number, r in enumerate(read_arc(_unpacked(content.as_py()))):
                        head, payload = _head(r["block"])
                        yield file, number, _field(head, KEY_FIELD), r["url"], r["ip"], timestamp(r["date"]), head.decode(), hashlib.sha1(payload).digest(), len(payload), *[payload] * payloads

        yield from _batches(records(), schema)

    return _files(spark, path).mapInArrow(run, "file string, number int, key string, url string, ip string, date string, head string, sha1 binary, payload_bytes bigint" + ", payload binary" * payloads)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 1000, key_type: str = "bigint", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """The ARC files in arc_path as WARC files in warc_path; keys are compared as key_type."""
    light, records = arc_records(spark, arc_path, payloads=False), arc_records(spark, arc_path)
    place = ["key", "url", "file", "number"]
    keyed = materialise(light.where(F.col("payload_bytes") >= least_bytes).select("sha1", *place, F.col("key").try_cast(key_type).alias("k")), "payload-keys")
    best = keyed.groupBy("sha1").agg(F.max(F.struct("k", *place)).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that its size is known, and payloads are shuffled only if it is too large to broadcast.
    revisits = materialise(keyed.join(best, "sha1").where("NOT k <=> to.k").select("file", "number", F.struct(*[f"to.{c}" for c in place]).alias("to")), "revisits")
    joined = records.join(revisits, ["file", "number"], "left").withColumn("task", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = 0

        def lines() -> Iterator[str]:
            nonlocal task
            for b in batches:
                for r in (r for low in range(0, b.num_rows, 64) for r in b.slice(low, 64).to_pylist()):
                    to, task = r["to"], r["task"]
                    refers = record_id(*(to[c] for c in place)) if to else None
                    payload = "" if to else r["payload"].decode()
                    yield warc_record("revisit" if to else "response", record_id(*(r[c] for c in place)), r["url"], r["ip"], r["date"], r["head"], payload, digest_field(r["sha1"]), refers)

        yield from _archives(lines(), WARC_END, lambda n: warcinfo(f"pages-{task:05d}-{n:05d}.warc.gz", "1996-10-01T00:00:00Z"), archive_bytes)

    _write(joined.mapInArrow(run, "value string"), WARC_END, warc_path)


def warc_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each response and revisit of the WARC files in path: (record_id, record_type, url, date, key, payload_bytes, payload_digest, refers_to), payload if asked for.

    A response's digest and length are those of the payload read, which must be the declared ones; a revisit's are
    those that it declares.
    """
    names = ["record_id", "record_type", "url", "date", "key", "payload_bytes", "payload_digest", "refers_to"]
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names] + [("payload", pa.binary())] * payloads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for content in b.column(1):
                    for f, block in read_warc(_unpacked(content.as_py())):
                        if f["warc-type"] == "warcinfo":
                            continue
                        head, payload = _head(block)
                        declared = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:"))
                        size = int(_field(head, "Content-Length") or 0)
                        if f["warc-type"] != "revisit" and (hashlib.sha1(payload).digest() != declared or len(payload) != size):
                            raise ValueError(f"{f['warc-record-id']}: its payload isn't the declared one")
                        yield f["warc-record-id"], f["warc-type"], f["warc-target-uri"], f["warc-date"], _field(head, KEY_FIELD), size, declared.hex(), f.get("warc-refers-to"), *[payload] * payloads

        yield from _batches(records(), schema)

    return _files(spark, path).mapInArrow(run, ", ".join(f"{n} {'bigint' if n == 'payload_bytes' else 'string'}" for n in names) + ", payload binary" * payloads)


def archive_pages(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages through ARC files, their conversion and back: (key, payload_bytes, payload_digest, record_type, refers_to) by the WARC files' records."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    kind = dict(pages.dtypes)[key_col]
    write_arc(pages, arc, key_col, url_col, payload_col, archive_bytes)
    convert(spark, arc, warc, least_bytes, kind, archive_bytes)
    records = materialise(warc_records(spark, warc).select("record_id", "record_type", "key", "payload_bytes", "payload_digest", "refers_to"), "warc-records")
    named = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("to")).distinct()
    revisits = records.where("record_type = 'revisit'").join(named, "refers_to", "left").select("key", "payload_bytes", "payload_digest", "record_type", "to")
    out = records.where("record_type = 'response'").select("key", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("to")).unionByName(revisits)
    return out.select(F.nullif("key", F.lit("")).cast(kind).alias(key_col), "payload_bytes", "payload_digest", "record_type", F.nullif("to", F.lit("")).cast(kind).alias("refers_to"))
