"""WARC (7): archives of gzip members, and a splittable reader.

Writing: equal payloads (by SHA-1) are one `response` record, that of the largest page_id; the others become `revisit`
records that refer to it and carry no payload. Every record is a gzip member of its own. A task writes its archives
through pyarrow's file systems under names of its own attempt; only archives listed in the manifest that Spark commits
count, so what a lost task has left behind is never read.

Reading: the archives are cut into byte ranges without looking into them. A task looks for the gzip magic from its
range's start, takes the first candidate whose first bytes decode to a WARC record header, and from there goes from
member to member. It owns the records that start inside its range and reads on past its end to complete the last.

Defined cases: null html is the empty payload, null url or page_id leave their header out and are read back as null.
Ids are read back in the type they had, strings percent-encoded in between.
Of repeated rows with one page_id and payload one is the response. An empty table gives no archive and no rows. Only
page_id, url and html of the input are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import cut, discard, key_join, new_folder, partitions, prepare

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes of an archive after which a task begins the next; bytes of a reader's range.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
_READ = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def file_system(path: str):
    """The pyarrow file system of a Hadoop path, and the path in it."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if mark and scheme.lower() in ("s3a", "s3n"):
        path = f"s3://{rest}"
    elif mark and scheme.lower() in ("wasb", "wasbs"):
        container, _, host = rest.partition("@")
        path = f"abfs{scheme[4:]}://{container}@{host.replace('.blob.', '.dfs.')}"
    return fs.FileSystem.from_uri(path)


def _header(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record(page_id, url: str | None, sha1: bytes, size: int, payload: bytes | None, refers_to) -> bytes:
    """A record as one gzip member; without payload it is a revisit."""
    block = b"" if payload is None else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{hashlib.md5(f'{page_id} {url}'.encode(), usedforsecurity=False).hexdigest()}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", "sha1:" + digest_text(sha1)),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{quote(str(refers_to), safe='')}>"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if payload is None else None),
        ("Page-ID", None if page_id is None else quote(str(page_id), safe="")),
        ("Payload-Length", size),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(_header(fields) + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives; gives their manifest: path, bytes, records, id_type (of page_id)."""
    spark = prepare(pages.sparkSession)
    folder = folder or new_folder(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    stored = cut(
        pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"sha1": F.unhex(F.sha1("html")), "size": F.octet_length("html").cast("long")}),
        "pages",
    )
    order = F.struct(F.col("page_id").isNotNull(), "page_id", "row")
    # A table of its own, so that AQE can split a digest of very many pages in the join.
    chosen = cut(stored.groupBy("sha1").agg(F.max("page_id").alias("target"), F.max_by("row", order).alias("chosen"), F.count("*").alias("n")).where("n > 1").drop("n"), "chosen")
    revisits = cut(stored.select("row", "page_id", "url", "sha1", "size").join(chosen, "sha1").where("row <> chosen"), "revisits")
    responses = key_join(stored, revisits.select("row"), ["row"], "left_anti", rows=1_000_000)
    columns = ["page_id", "url", "sha1", "size", "html", "target"]
    records = responses.withColumn("target", F.lit(None).cast(kind)).select(columns).unionByName(revisits.withColumn("html", F.lit(None).cast("string")).select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, out, size, n = TaskContext.get(), 0, None, 0, 0
        system, base = file_system(folder)
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, size, n, serial
            if out is not None:
                out.close()
                done.append((name, size, n))
                out, size, n, serial = None, 0, 0, serial + 1

        for batch in batches:
            for page_id, url, sha1, length, text, target in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if out is None:
                    name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{serial}.warc.gz"
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                member = record(page_id, url, sha1, length, None if text is None else text.encode(), target)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0].rsplit("/", 1)[1] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["path", "bytes", "records"])

    manifest = records.mapInArrow(run, "path string, bytes long, records long")
    out = cut(manifest.select(F.concat(F.lit(folder + "/"), "path").alias("path"), "bytes", "records", F.lit(kind).alias("id_type")), "warc-manifest")
    discard(stored, chosen, revisits)
    return out


class _Input:
    """An archive from some byte on, read as it is asked for."""

    def __init__(self, path: str):
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def at(self, start: int, n: int = _READ) -> bytes:
        self.file.seek(start)
        return self.file.read(min(n, max(0, self.size - start)))


def member(source: _Input, start: int) -> tuple[bytes, int] | None:
    """The decoded gzip member at start and where it ends; None if it is no whole member that begins a record."""
    unpacker, parts, at = zlib.decompressobj(31), [], start
    while True:
        data = source.at(at)
        if not data:
            return None
        try:
            parts.append(unpacker.decompress(data))
        except zlib.error:
            return None
        if len(parts) == 1 and not parts[0].startswith(VERSION[: len(parts[0])]):
            return None
        at += len(data)
        if unpacker.eof:
            whole = b"".join(parts)
            return (whole, at - len(unpacker.unused_data)) if whole.startswith(VERSION) else None


def starts(source: _Input, first: int, end: int) -> int | None:
    """The first record that starts in [first, end)."""
    at = first
    while at < end:
        data = source.at(at, min(_READ, end - at + len(MAGIC) - 1))
        found = data.find(MAGIC)
        while found >= 0 and at + found < end:
            if member(source, at + found) is not None:
                return at + found
            found = data.find(MAGIC, found + 1)
        if at + len(data) >= end or len(data) < len(MAGIC):
            return None
        at += len(data) - len(MAGIC) + 1
    return None


def parse(whole: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(manifest: DataFrame, kind: str | None = None, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload] of every record.

    Ids are cast to `kind`, or to the type that the manifest gives. A response's length and digest are those of the
    payload that is read."""
    spark = manifest.sparkSession
    if kind is None:
        first = manifest.select("id_type").first() if "id_type" in manifest.columns else None
        kind = first["id_type"] if first else "bigint"
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("first"))
    ranges = ranges.repartition(partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                source, end, out = _Input(path), first + range_bytes, []
                at = starts(source, first, min(end, source.size))
                while at is not None and at < min(end, source.size):
                    found = member(source, at)
                    if found is None:
                        raise ValueError(f"{path}: no record at {at}")
                    fields, block = parse(found[0])
                    at = found[1]
                    digest, size, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Payload-Length"]), None
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if digest_text(hashlib.sha1(payload, usedforsecurity=False).digest()) != digest:
                            raise ValueError(f"{path}: a payload before {at} does not match its digest")
                    url = fields.get("WARC-Target-URI")
                    page, target = fields.get("Page-ID"), fields.get("WARC-Refers-To")
                    out.append((None if page is None else unquote(page), None if url is None else unquote(url), size, digest, fields["WARC-Type"], None if target is None else unquote(target.removeprefix("<urn:page:").removesuffix(">")), payload if payloads else None))
                    if len(out) == 1000:
                        yield result(out)
                        out = []
                yield result(out)

    def result(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    rows = ranges.select("path", "first").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    rows = rows.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
    return rows if payloads else rows.drop("payload")
