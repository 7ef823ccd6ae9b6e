"""WARC archives as a PySpark data source, and the writing of pages with revisit records.

Reading: partitions are runs of whole archive files of about ``PARTITION_BYTES``, planned by listing; filters on
record_type, target_uri, record_id and page_id are pushed into the reader, which parses a record's headers first and skips the
block of a record that is not wanted; without the column ``payload`` (option ``payload=false``) no block is kept at all.
Files go through pyarrow's file systems, so local and object stores both work. Each record is a gzip member of its own.

Defined cases: a null payload is empty; null urls write no target; a null page_id writes no page header and reads back as
null; repeated rows write a record each; equal payloads of ``min_revisit`` bytes or more become one response (the largest
page_id; rows that tie on it are all responses) and revisits that name it; an empty table writes no record and reads as
no rows; payloads are held a record at a time. Pages are told apart by SHA-256, not by their digest alone.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ._common import scratch, stored

PARTITION_BYTES = 32 << 20
MIN_REVISIT = 1000
#: A payload of more than this part of all rows is hot.
HOT = 2000
#: Fixed values of the format.
VERSION, REVISIT_PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_id string, record_type string, target_uri string, page_id long, refers_to long, content_length long, "
    "payload_digest string, payload_bytes long, payload binary"
)
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Header of each pushed-down column.
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "page_id": "x-page-id"}


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def record_bytes(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record: a response with the payload, or (payload None) a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "revisit" if payload is None else "response"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}"] + [f"X-Refers-To-Page-Id: {refers_to}"] * (refers_to is not None)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(headers in lower case, payload) of the wanted records of an uncompressed stream; other blocks are passed over, by a jump where the stream can jump."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        last = None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t" and last:  # a folded header
                head[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            head[last] = value.strip().decode("utf-8", "replace")
        size = int(head.get("content-length", 0))
        if not wanted(head):
            _skip(stream, size)
            continue
        body = None
        if payload and head.get("warc-type") != "revisit":
            body = stream.read(size)
            if len(body) < size:
                raise EOFError(f"record {head.get('warc-record-id')} is cut short")
            if head.get("content-type", "").startswith("application/http"):
                cut = body.find(b"\r\n\r\n")
                body = body[cut + 4 :] if cut >= 0 else b""
        else:
            _skip(stream, size)
        yield head, body


def _skip(stream, size: int) -> None:
    if size > 1 << 16 and not isinstance(stream, gzip.GzipFile) and stream.seekable():
        stream.seek(size - 1, 1)
        size = 1  # reading the last byte tells whether it is there
    while size > 0:
        got = stream.read(min(size, 1 << 20))
        if not got:
            raise EOFError("a record is cut short")
        size -= len(got)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.options, self.columns = options["path"], options, columns
        self.tests: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.tests.append((_HEADERS[f.attribute[0]], frozenset(str(v) for v in values if v is not None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _open(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type != fs.FileType.NotFound else None
        if found is None:
            raise FileNotFoundError(self.path)
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        groups: list[list[str]] = []
        held = PARTITION_BYTES
        for path, size in files:
            if held + size > PARTITION_BYTES and held:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "content_length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        with_payload = self.options.get("payload", "true") != "false"
        wanted = lambda head: all(head.get(name) in values for name, values in self.tests)
        rows: list[dict] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=kinds.get(c, pa.string())) for c in self.columns], names=self.columns)

        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for head, body in read_records(stream, wanted, with_payload):
                    number = lambda name, head=head: int(head[name]) if name in head else None
                    digest = head.get("warc-payload-digest", "")
                    rows.append({
                        "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
                        "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "content_length": number("content-length"),
                        "payload_digest": sha1(body).hexdigest() if body is not None else digest.removeprefix("sha1:") or None,
                        "payload_bytes": len(body) if body is not None else number("x-payload-length"), "payload": body,
                    })
                    held += len(body or b"")
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    records: int


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.run = uuid.uuid4().hex

    def write(self, rows) -> Written:
        """One archive a task, under a name of its own attempt; columns page_id, url, digest, size, payload, refers_to."""
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _open(self.path)
        path, n, out = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{self.run}.warc.gz", 0, None
        for r in rows:
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(path, compression=None)
            payload = None if r["payload"] is None else bytes(r["payload"])
            pack = zlib.compressobj(1, zlib.DEFLATED, 31)
            out.write(pack.compress(record_bytes(r["page_id"], r["url"], r["digest"], r["size"], payload, r["refers_to"])) + pack.flush())
            n += 1
        if out is not None:
            out.close()
        return Written(path if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        """Keeps the archives of the committed attempts only."""
        from pyarrow import fs

        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        kept = {m.path for m in messages if m is not None}
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.is_file and f.path.endswith(f"{self.run}.warc.gz") and f.path not in kept:
                system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.is_file and f.path.endswith(f"{self.run}.warc.gz"):
                system.delete_file(f.path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Writes a record per row to ``path``; equal payloads are stored once (see the module's text)."""
    register(pages.sparkSession)
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long"), "key": F.unhex(F.sha2("payload", 256))})
    # the counting aggregates before it shuffles, and reads no payload further than its hash
    large = rows.filter(F.col("size") >= min_revisit)
    counted = large.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again, total = stored(counted, "again"), pages.count()
    # payloads that are a large share of all rows: under HOT of them, so they go to every task and their rows stay where they are
    often = F.col("n") * HOT > total
    met = large.join(F.broadcast(again.filter(often).select("key", F.col("refers_to").alias("hot"), F.lit(True).alias("known"))), "key", "left")
    usual = met.filter("known is null").drop("hot", "known").join(again.filter(~often).drop("n"), "key", "left")
    joined = usual.unionByName(met.filter("known").drop("known").withColumnRenamed("hot", "refers_to"))
    joined = joined.unionByName(rows.filter(F.col("size") < min_revisit).withColumn("refers_to", F.lit(None).cast("long")))
    visit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    out = joined.select(
        "page_id", "url", "digest", "size", F.when(~visit, F.col("payload")).alias("payload"), F.when(visit, F.col("refers_to")).alias("refers_to")
    )
    out.write.format("warc").mode("append").option("path", path).save()


def warc_records(pages: DataFrame) -> DataFrame:
    """Archives every row of ``pages`` and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    archive(pages, path)
    back = spark.read.format("warc").option("path", path).load()
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
