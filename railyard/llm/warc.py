"""WARC archives with revisit resolution.

* ``write_archive`` writes one record per row, each a gzip member of its own
  that the task makes, so readers can seek to a record. Files are written by
  Spark's text writer, committed, retried and placed like any other table (any
  store, lost executors included): the last byte of a gzip member is the
  highest of its length, zero for records under 16 MiB, and is written as the
  writer's line separator; a longer record is followed by an empty member. Each
  file begins with a warcinfo record and holds a bounded number of bytes.
* ``read_archive`` parses the files by Content-Length in tasks (a payload may
  hold any bytes; members may hold any number of records).
* ``resolve`` shuffles headers only, by payload digest: the record with the
  largest key of each payload is the response (a partial ``max``, so a payload
  that a third of all rows share costs a row per task), the others join it and
  become revisits.
* ``write_deduplicated`` gives the revisits of each file to the task that reads
  it, which writes the archive anew with fresh headers: responses with their
  payload, revisits with the headers WARC-Refers-To,
  WARC-Refers-To-Target-URI and WARC-Profile and no payload.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_folder, stored

CRLF = "\r\n"
END = b"\r\n\r\n"
#: Records of a file at most, and bytes of their payloads: a task reads whole files.
RECORDS_PER_FILE, FILE_BYTES = 2_000, 256 << 20
#: Payloads that a task gathers before it gives them out.
BATCH_BYTES = 4 << 20
#: A gzip member that is longer unpacked is read as a stream.
MEMBER_BYTES = 8 << 20
#: Revisits (some 200 bytes each) are broadcast to the readers up to so many, else files meet them by a shuffle.
BROADCAST_REVISITS = 500_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A value that stays on its line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1" + CRLF + "".join(f"{k}: {_header_value(v)}{CRLF}" for k, v in [*fields, ("Content-Length", str(len(block)))]) + CRLF
    return head.encode("utf-8", "replace") + block + END


def _member(record: bytes) -> bytes:
    """The record as a gzip member but for the last byte, a zero."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:  # the record's length needs its highest byte
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += pack.flush()
    return out[:-1]


def _info(name: str, date: str) -> bytes:
    block = b"software: railyard" + CRLF.encode() + b"format: WARC File Format 1.1" + CRLF.encode()
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date),
                    ("Content-Type", "application/warc-fields")], block)


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _fields(kind: str, key, uid: str, url: str | None, digest: str, size: int, date: str) -> list[tuple[str, str]]:
    return [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uid}>"), ("WARC-Date", date), ("WARC-Target-URI", url or ""),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
            ("X-Payload-Length", str(size)), *([] if key is None else [("X-Record-Key", str(key))])]


def _given(members: Iterator[bytes], name: str, date: str, per_file: int) -> Iterator[pa.RecordBatch]:
    """The members as rows, every ``per_file`` of them after a warcinfo record: with it they fill a file."""
    out, held = [], 0
    for n, member in enumerate(members):
        if n % per_file == 0:
            out.append(_member(_info(f"{name}:{n}", date)))
        out.append(member)
        held += len(member)
        if held >= BATCH_BYTES or len(out) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def _write(members: DataFrame, path: str, per_file: int) -> None:
    """Rows of :func:`_given` as files. The text writer takes the bytes as they are."""
    spark = members.sparkSession
    text = members.select(F.col("value").cast("string"))
    text.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file + 1).text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(at):  # a listing of names
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name.removesuffix('.txt')}.warc.gz"))


def records_per_file(pages: DataFrame, payload_col: str = "html") -> int:
    """So many that a file stays under ``FILE_BYTES`` of payloads."""
    longest = pages.agg(F.max(F.octet_length(pages[payload_col]))).first()[0] or 0
    return max(1, min(RECORDS_PER_FILE, FILE_BYTES // (longest + 1)))


def write_archive(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> None:
    """A response record for each row: key, url, payload (UTF-8; null: empty),
    dated ``date`` (the time of the call). Keys are kept in the header
    X-Record-Key (absent for null)."""
    date, per_file = date or _now(), records_per_file(pages, payload_col)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                for uid, key, url, html in zip(*(batch.slice(lo, 200).column(c).to_pylist() for c in ("uid", "key", "url", "html"))):
                    payload = (html or "").encode("utf-8", "replace")
                    digest = payload_digest(payload)
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{uid}:{key}:{digest}:{url}")
                    yield _member(_record(_fields("response", key, str(name), url, digest, len(payload), date), HTTP + payload))

    def run(batches):
        name = f"{path}:{TaskContext.get().partitionId()}"
        return _given(members(batches), name, date, per_file)

    rows = pages.select(F.monotonically_increasing_id().alias("uid"), pages[key_col].alias("key"), pages[url_col].alias("url"), pages[payload_col].alias("html"))
    _write(rows.mapInArrow(run, "value binary"), path, per_file)


def parse(raw: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; of a stream, one record at a time is held."""
    stream = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield head, block


def unpacked(content: pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a gzip file, member by member; one that is long unpacked is
    read as a stream, so memory follows the longest record, not the file."""
    at, whole = 0, memoryview(content)
    while at < len(whole):
        start, out, held = at, [], 0
        member = zlib.decompressobj(31)
        while not member.eof and held < MEMBER_BYTES and at < len(whole):
            chunk = whole[at:at + (1 << 16)]
            out.append(member.decompress(chunk, MEMBER_BYTES - held))
            held += len(out[-1])
            at += len(chunk)
        if not member.eof:  # long, or cut off (which the stream's reader tells)
            out = []
            rest = gzip.GzipFile(fileobj=pa.BufferReader(content.slice(start)))
            yield from parse(io.BufferedReader(rest, 1 << 18))
            return
        at -= len(member.unused_data)
        yield from parse(b"".join(out))


HEADERS = "file string, number int, record_id string, key string, url string, date string, record_type string, digest string, n_payload bigint, refers_to string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("file"), "content")


def _responses(content: pa.Buffer) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number in the file, headers, payload) of the records with a payload or in place of one."""
    for number, (head, block) in enumerate(unpacked(content)):
        if head["warc-type"] in ("response", "revisit"):
            body = block.partition(END)[2]
            if head["warc-type"] == "response" and payload_digest(body) != head.get("warc-payload-digest", "").removeprefix("sha1:"):
                raise ValueError(f"payload digest of {head['warc-record-id']} does not fit")
            yield number, head, body


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record: its file, number there and headers, and with ``payload`` the payload."""
    schema = HEADERS + (", payload binary" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"number": pa.int32(), "n_payload": pa.int64(), "payload": pa.binary()}.get(n, pa.string()) for n in names]
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows: list[tuple] = []
                held = 0
                for number, head, body in _responses(content.as_buffer()):
                    row = (file, number, head["warc-record-id"], head.get("x-record-key"), head.get("warc-target-uri"), head.get("warc-date"), head["warc-type"],
                           head.get("warc-payload-digest", "").removeprefix("sha1:"), int(head.get("x-payload-length", len(body))), head.get("x-refers-to-key"))
                    rows.append(row + ((body,) if payload else ()))
                    held += len(body) if payload else 0
                    if len(rows) >= 500 or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _files(spark, path).mapInArrow(run, schema)


def resolve(headers: DataFrame, key_type: str, least: int = 0) -> DataFrame:
    """record_id, record_type, refers_to (key), refers_id and refers_url for
    each record: of records with equal payloads of at least ``least`` bytes,
    the one with the largest key (a null key is smaller than any; then the
    largest record id) is the response and the others revisit it."""
    order = F.struct(F.col("key").cast(key_type).alias("k"), "record_id", "url")
    first = headers.where(F.col("n_payload") >= least).groupBy("digest", "n_payload").agg(F.max(order).alias("best"))
    joined = headers.join(first, ["digest", "n_payload"], "left")
    revisit = F.col("best.record_id").isNotNull() & (F.col("best.record_id") != F.col("record_id"))
    pick = lambda name: F.when(revisit, F.col(f"best.{name}"))
    return joined.select("file", "number", "record_id", "key", "url", "date", "digest", "n_payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         pick("k").alias("refers_to"), pick("record_id").alias("refers_id"), pick("url").alias("refers_url"))


def write_deduplicated(spark: SparkSession, source: str, resolved: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, date: str | None = None) -> None:
    """The records of ``source`` anew: fresh ids, dates and headers, payloads of
    responses only. ``resolved``: rows of :func:`resolve`."""
    date = date or _now()
    revisits = resolved.where("record_type = 'revisit'").select("file", F.struct("number", "refers_to", "refers_id", "refers_url").alias("r"))
    few = resolved.where("record_type = 'revisit'").count() <= BROADCAST_REVISITS
    revisits = revisits.groupBy("file").agg(F.collect_list("r").alias("revisits"))  # as many as a file has records, at most
    files = _files(spark, source).join(F.broadcast(revisits) if few else revisits.hint("shuffle_hash"), "file", "left")

    def fresh(record_id: str) -> str:
        return str(uuid.uuid5(uuid.NAMESPACE_URL, f"deduplicated:{record_id}"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content, own in zip(batch.column("content"), batch.column("revisits").to_pylist()):
                own = {r["number"]: r for r in own or []}
                for number, head, body in _responses(content.as_buffer()):
                    r = own.get(number)
                    fields = _fields("response" if r is None else "revisit", head.get("x-record-key"), fresh(head["warc-record-id"]), head.get("warc-target-uri"),
                                     head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), date)
                    if r is not None:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{fresh(r['refers_id'])}>"), ("WARC-Refers-To-Target-URI", r["refers_url"] or ""),
                                   *([] if r["refers_to"] is None else [("X-Refers-To-Key", str(r["refers_to"]))])]
                    yield _member(_record(fields, HTTP if r is not None else HTTP + body))

    def run(batches):
        name = f"{path}:{TaskContext.get().partitionId()}"
        return _given(members(batches), name, date, per_file)

    _write(files.mapInArrow(run, "value binary"), path, per_file)


def deduplicated_archive(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, path: str | None = None) -> DataFrame:
    """Write, read back, resolve, write deduplicated, read back: a row per
    page with its key, payload_bytes, payload_digest, record_type and
    refers_to, as the headers of the deduplicated archive say.

    A null payload is empty (its digest is that of no bytes) and takes part
    like any other; null keys and equal rows have records of their own; of
    equal rows one is the response. Other columns are not read; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    source, target = fresh_folder(spark, "archive"), path or fresh_folder(spark, "deduplicated")
    kind = pages.schema[key_col].dataType.simpleString()
    write_archive(pages, source, key_col, url_col, payload_col)
    resolved = stored(resolve(read_archive(spark, source), kind, least), "resolved")
    write_deduplicated(spark, source, resolved, target, records_per_file(pages, payload_col))
    back = read_archive(spark, target)
    return back.select(F.col("key").cast(kind).alias(key_col), F.col("n_payload").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                       "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
