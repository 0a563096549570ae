"""WARC archives as a Python data source, and a page table's round trip through them."""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from panmixia.llm.common import cut, give_back, salted, shared_dir

#: Payloads below this are never replaced by a revisit record.
LEAST_BYTES = 100
#: Repeated payloads up to this many (about 60 bytes each) are broadcast; more are joined in a shuffle.
BROADCAST_ROWS = 100_000
MANIFEST = "_manifest.json"
#: Bytes of an archive from which on a reader's next partition begins, at a record.
SPLIT_BYTES = 64 << 20
#: Payloads that a reader hands on at once.
BATCH_BYTES = 4 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, payload_bytes long, refers_to long, payload binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns that a header answers, for pushed filters.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "page_id": "x-page-id", "payload_digest": "warc-payload-digest"}


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    if "://" not in uri and not uri.startswith("file:"):
        return FileSystem.from_uri("file://" + uri)
    return FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _line(value: str) -> str:
    """Header values hold no line breaks; what would break one is percent-encoded."""
    return re.sub("[\r\n%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unline(value: str) -> str:
    return re.sub("%(0D|0A|25)", lambda m: chr(int(m[1], 16)), value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def record_bytes(row, date: str) -> bytes:
    """One record: headers, and for a response the payload behind its HTTP header. A revisit names the response that has its payload."""
    body = HTTP + row.html.encode("utf-8", "replace") if row.record_type == "response" else HTTP
    head = {
        "WARC-Type": row.record_type,
        "WARC-Record-ID": record_id(row.page_id, row.payload_digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if row.url is None else _line(row.url),
        "WARC-Payload-Digest": f"sha256:{row.payload_digest}",
        "WARC-Refers-To": None if row.refers_to is None else record_id(row.refers_to, row.payload_digest),
        "X-Page-ID": row.page_id,
        "X-Payload-Length": row.payload_bytes,
        "X-Refers-To-Page": row.refers_to,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row.record_type == "revisit" else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(body),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" tells its compressed and plain length, so that readers can skip it.

    The field holds lengths under 4 GiB; a longer member goes without, and readers decode it to find its end.
    """
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    told = size < 1 << 32 and len(raw) < 1 << 32
    head = b"\x1f\x8b\x08" + (b"\x04" if told else b"\0") + b"\0\0\0\0\0\x03"
    head += struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw)) if told else b""
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class _Window(io.RawIOBase):
    """Plain bytes of one gzip member, decoded only as far as they are read."""

    def __init__(self, source):
        self.source, self.inflater, self.plain = source, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, target):
        while not self.plain and not self.inflater.eof:
            raw = self.inflater.unconsumed_tail or self.source.read(4096)
            if not raw:
                break
            self.plain = self.inflater.decompress(raw, max(len(target), 2048))
        n = min(len(target), len(self.plain))
        target[:n], self.plain = self.plain[:n], self.plain[n:]
        return n

    def rest(self) -> bytes:
        """Compressed bytes read beyond the member's end, once all of it is decoded."""
        while not self.inflater.eof and self.readinto(bytearray(65536)):
            self.plain = b""
        return self.inflater.unused_data


def headers(stream) -> dict[str, str] | None:
    """The next record's headers with lower-case names; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


@dataclass
class Archive(InputPartition):
    """A stretch of whole records of a file."""

    uri: str
    start: int
    stop: int


def _value(column: str, head: dict[str, str]):
    raw = head.get(HEADERS[column])
    if raw is None:
        return None
    if column == "page_id":
        return int(raw)
    return raw.removeprefix("sha256:") if column == "payload_digest" else _unline(raw) if column == "target_uri" else raw


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.payload = options.get("payload", "load") != "skip"
        self.wanted: dict[str, set] = {}
        if types := options.get("recordtypes"):
            self.wanted["record_type"] = set(types.split(","))

    def pushFilters(self, filters: list[Filter]):
        """Equality on what headers hold is decided here, before a payload is decoded; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                have = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if have is None else have & values
            else:
                yield f

    def partitions(self):
        """Stretches of records that the manifest lists, or whole files where there is none; large first."""
        from pyarrow.fs import FileSelector, FileType

        fs, path = filesystem(self.uri)
        manifest = fs.get_file_info(f"{path}/{MANIFEST}")
        if manifest.type == FileType.File:
            with fs.open_input_stream(manifest.path) as f:
                found = [(f"{path}/{x['name']}", [0, *x.get("splits", []), x["length"]]) for x in json.loads(f.read())]
        elif (one := fs.get_file_info(path)).type == FileType.File:
            found = [(path, [0, one.size])]
        else:
            found = [(x.path, [0, x.size]) for x in fs.get_file_info(FileSelector(path)) if re.search(r"\.warc(\.gz)?$", x.path)]
        # a file system's own paths carry no scheme, so the folder's is kept
        base = self.uri.rstrip("/")
        at = [Archive(base if p == path else f"{base}/{p.rsplit('/', 1)[-1]}", a, z) for p, ends in found for a, z in zip(ends, ends[1:], strict=False)]
        return sorted(at, key=lambda a: a.start - a.stop) or [Archive("", 0, 0)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        try:
            yield from self._batches(partition)
        finally:
            give_back()

    def _batches(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        fs, path = filesystem(partition.uri)
        rows: dict[str, list] = {c: [] for c in COLUMNS}
        size = 0
        with fs.open_input_file(path) as f:
            source = io.BufferedReader(f, 1 << 20)
            records = (self._gzipped if path.endswith(".gz") else self._plain)(source, partition.start, partition.stop)
            for head, payload in records:
                for c in HEADERS:
                    rows[c].append(_value(c, head))
                length = head.get("x-payload-length")
                rows["payload_bytes"].append(int(length) if length else None if payload is None else len(payload))
                refers = head.get("x-refers-to-page")
                rows["refers_to"].append(int(refers) if refers else None)
                rows["payload"].append(payload)
                size += 200 + len(payload or b"")
                if size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = {c: [] for c in COLUMNS}, 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.string())) for c in COLUMNS], names=COLUMNS)

    def _take(self, head: dict[str, str]) -> bool:
        return all(_value(c, head) in values for c, values in self.wanted.items())

    def _body(self, head: dict[str, str], stream) -> bytes | None:
        """The payload behind the HTTP header; revisits have none."""
        raw = stream.read(int(head.get("content-length", 0)))
        if head.get("warc-type") == "revisit":
            return None
        return raw.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else raw

    def _plain(self, source, at: int, stop: int):
        source.seek(at)
        # what is left of a record is the four line breaks behind it
        while source.tell() + 4 < stop and (head := headers(source)) is not None:
            length = int(head.get("content-length", 0))
            if not self._take(head):
                source.seek(length, 1)
            elif self.payload:
                yield head, self._body(head, source)
            else:
                source.seek(length, 1)
                yield head, None

    def _gzipped(self, source, at: int, stop: int):
        """Members one by one: headers are decoded first, the rest only if its payload is wanted."""
        while at < stop:
            source.seek(at)
            lead = source.read(24)
            if len(lead) < 10:
                return
            known = lead[3] & 4 and lead[12:14] == b"sl" and struct.unpack("<I", lead[16:20])[0]
            source.seek(at)
            inner = _Window(source)
            stream = io.BufferedReader(inner, 2048)
            head = headers(stream)
            if head is not None and self._take(head):
                yield head, self._body(head, stream) if self.payload else None
            if known:
                at += known
            else:
                rest = inner.rest()
                at = source.tell() - len(rest)


@dataclass
class Written(WriterCommitMessage):
    name: str
    length: int
    splits: list[int]


class WarcWriter(DataSourceWriter):
    """Each task attempt writes a file of its own; the manifest, written on commit, names those that count."""

    def __init__(self, options):
        self.uri = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, rows) -> Written:
        fs, path = filesystem(self.uri)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc" + ".gz" * self.gzip
        fs.create_dir(path, recursive=True)
        length, splits = 0, [0]
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for row in rows:
                if length - splits[-1] >= self.split:
                    splits.append(length)
                raw = record_bytes(row, self.date)
                raw = member(raw) if self.gzip else raw
                out.write(raw)
                length += len(raw)
        give_back()
        return Written(name, length, splits[1:])

    def commit(self, messages):
        fs, path = filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([{"name": m.name, "length": m.length, "splits": m.splits} for m in messages if m and m.length]).encode())

    def abort(self, messages):
        fs, path = filesystem(self.uri)
        for m in messages:
            if m:
                fs.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    """``warc``: options path, payload (load or skip), recordTypes, compression (gzip or none), splitBytes and date of what is written."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand it filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, uri: str, **options) -> None:
    """Archive pages under ``uri``. Of records with equal payloads of 100 bytes or more, those of the smallest page_id are responses and the others revisit it.

    A null html is an empty payload; a null page_id is larger than any other, and where a group has
    no other its records are all responses, as are rows that repeat the smallest page_id. Other
    columns are not read.
    """
    register(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    narrow = rows.where(F.col("payload_bytes") >= LEAST_BYTES).select("page_id", "payload_digest")
    firsts = cut(narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n"))
    if firsts.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        rows = salted(rows, firsts, ["payload_digest"], 16, [F.col("page_id")])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )
    rows.write.format("warc").mode("append").options(path=uri, **options).save()


def read(spark: SparkSession, uri: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=uri, **options).load()


def checked(records: DataFrame) -> DataFrame:
    """Records whose responses have length and digest of the payload that was read; one that its header contradicts fails.

    A revisit has no payload, so its header's values stay: those of the response it refers to.
    """
    length, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    read_back = F.col("record_type") == "response"
    same = F.col("payload").isNotNull() & length.eqNullSafe(F.col("payload_bytes")) & digest.eqNullSafe(F.col("payload_digest"))
    wrong = F.raise_error(F.concat(F.lit("payload and header differ: "), F.coalesce("record_id", F.lit(""))))
    return records.select(
        "page_id", F.when(~read_back, F.col("payload_bytes")).when(same, length).otherwise(wrong.cast("long")).alias("payload_bytes"),
        F.when(~read_back, F.col("payload_digest")).when(same, digest).otherwise(wrong.cast("string")).alias("payload_digest"), "record_type", "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and read them back: responses with their payloads, revisits by their headers alone.

    Both filters are decided on the headers, before a payload is decoded.
    """
    spark = pages.sparkSession
    uri = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, uri)
    responses = read(spark, uri).where(F.col("record_type") == "response")
    revisits = read(spark, uri, payload="skip").where(F.col("record_type") == "revisit")
    return checked(responses.unionByName(revisits))
