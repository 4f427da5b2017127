"""WARC archives of pages in which equal payloads are stored once.

Only headers are shuffled by payload digest: they say which record stays a response (the smallest id) and which become
revisits. Payloads then go to the archives from the tasks that read them; a revisit has headers alone and names its response.
Archives are gzip files of one member per record, written and read by a Spark data source.
"""

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from gridmill.operators.skew import counted_hot_keys, salted_join
from gridmill.sources.files import StagedWriter, Written, store
from gridmill.sources.work import stage

LEAST = 100             # payloads of fewer bytes are always stored
ROLL = 256_000_000      # an archive is closed once it has so many bytes
BATCH = 8_000_000       # payload bytes of a batch that is read
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TEXTS = ("record_id", "type", "date", "uri", "page_id", "refers_to", "refers_to_uri", "payload_digest")
SCHEMA = ", ".join(f"{c} string" for c in TEXTS) + ", payload_bytes long, payload binary"
ARROW = pa.schema([*[(c, pa.string()) for c in TEXTS], ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def record_id(page: str | None, digest: str) -> str:
    """The same for every attempt of a task, so a revisit can name a record that another task writes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}:{page or ""}')}>"


def _line(value: str) -> str:
    """A header value; blanks and control characters would end it and are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def page_record(page: str | None, uri: str | None, digest: str, n: int, payload: bytes | None, first: str | None,
                first_uri: str | None, date: str) -> bytes:
    """A response, or a revisit of `first` where the payload is null."""
    revisit = payload is None
    shown = lambda v: None if v is None else _line(v)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest) if not revisit
               else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'revisit:{digest}:{page or ""}')}>"),
              ("WARC-Date", date), ("WARC-Target-URI", shown(uri)), ("X-Page-ID", shown(page)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Target-URI", shown(first_uri))]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return record(fields, http(n) + (payload or b""))


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, wbits=31)
    return packer.compress(data) + packer.flush()


class ArchiveWriter(StagedWriter, DataSourceArrowWriter):
    """One archive per task, and another one after each ROLL bytes."""

    def __init__(self, out: str, overwrite: bool):
        super().__init__(out, overwrite)
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, out, size = self.begin(), None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("page", "uri", "digest", "n", "payload", "first", "first_uri")]
                for row in zip(*columns):
                    if out is None or size >= ROLL:
                        if out is not None:
                            out.close()
                        name = f"pages-{TaskContext.get().partitionId():06}-{done.files:04}.warc.gz"
                        out, size = self.open(done, name), 0
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.staging + name)}>"),
                                ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                        out.write(member(record(info, b"format: WARC File Format 1.1\r\n")))
                    data = member(page_record(*(v.as_py() for v in row), self.date))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return self.end(done)


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload

    def partitions(self) -> list[Archive]:
        files, root = store(self.path)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [Archive(i.path) for i in found if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive at all
            return
        rows, size = [], 0
        for fields, block in records(store(self.path)[0], partition.path):
            if fields.get("warc-type") not in ("response", "revisit"):
                continue
            payload = block[block.index(b"\r\n\r\n") + 4:] if fields["warc-type"] == "response" else None
            digest = sha256(payload).hexdigest() if payload is not None else fields["warc-payload-digest"].removeprefix("sha256:")
            if fields["warc-payload-digest"] != f"sha256:{digest}":
                raise ValueError(f"{partition.path}: the payload of {fields['warc-record-id']} is not the one it was written with")
            rows.append((fields["warc-record-id"], fields["warc-type"], fields["warc-date"], fields.get("warc-target-uri"),
                         fields.get("x-page-id"), fields.get("warc-refers-to"), fields.get("warc-refers-to-target-uri"), digest,
                         None if payload is None else len(payload), payload if self.payload else None))
            size += 500 + (len(payload or b"") if self.payload else 0)
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


def records(files: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an archive, one at a time."""
    with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        while version := stream.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"{path}: not a WARC record: {version[:40]!r}")
            fields = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name.lower()] = value.strip()
            n = int(fields["content-length"])
            block = stream.read(n)
            if len(block) < n or stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record is cut off")
            yield fields, block


class WarcArchives(DataSource):
    """WARC archives of a folder; option payload=false leaves payloads out of what is read."""

    @classmethod
    def name(cls) -> str:
        return "page_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(df: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> None:
    """Write a record per row; of equal payloads of at least `least` bytes one is stored.

    Of such payloads the rows with the smallest key are responses (one, where keys are unique), the others revisits of them; a null
    key comes after all others. A null html is an empty payload, a null url or key has no header. Other columns are not read. An
    empty table gives an empty folder.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("key", "uri", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"), "payload")
    heads = rows.where(F.col("n") >= least).groupBy("digest").agg(
        F.min(F.struct(F.col("key").isNull(), "key", "uri")).alias("first"), F.count(F.lit(1)).alias("copies"))
    shared = stage(heads.where("copies > 1").select("digest", "copies", F.col("first.key").alias("first"),
                                                    F.col("first.uri").alias("first_uri")), "shared_payloads")
    hot = counted_hot_keys(shared.select("digest", F.col("copies").alias("n")), "digest")
    placed = salted_join(shared.drop("copies").withColumn("shared", F.lit(True)), rows, "digest", hot, spread=["key", "uri"], how="right")
    revisit = F.coalesce(F.col("shared") & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    df.sparkSession.dataSource.register(WarcArchives)
    placed.select(F.col("key").cast("string").alias("page"), "uri", "digest", "n", F.when(~revisit, F.col("payload")).alias("payload"),
                  F.col("first").cast("string").alias("first"), "first_uri").write.format("page_warc").mode("overwrite").option("path", out).save()


def read_archives(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """The records of all archives of a folder as they are; every payload is compared with its digest."""
    spark.dataSource.register(WarcArchives)
    return spark.read.format("page_warc").option("payload", str(payload).lower()).load(out)


def read_pages(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """(page_id, type, uri, payload_digest, payload_bytes, refers_to, payload) of every record of a folder, revisits with the payload
    of their response.

    `refers_to` is the page_id of the response. A revisit whose response is in none of the archives has no payload and no refers_to.
    """
    kept = ["payload"] if payload else []
    columns = ["page_id", "type", "uri", "payload_digest"]
    heads = stage(read_archives(spark, out, payload=False).drop("payload"), "records")
    stored = (read_archives(spark, out) if payload else heads).where("type = 'response'")
    again = heads.where("type = 'revisit'").select(*columns, F.col("refers_to").alias("record_id"))
    counts = again.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    named = stored.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", *kept)
    named = named.join(counts.select("record_id"), "record_id", "left_semi").dropDuplicates(["record_id"])
    met = salted_join(named, again, "record_id", counted_hot_keys(counts, "record_id"), spread=["page_id"], how="right")
    out = [*columns, "payload_bytes", "refers_to", *kept]
    return stored.withColumn("refers_to", F.lit(None).cast("string")).select(*out).unionByName(met.select(*out))
