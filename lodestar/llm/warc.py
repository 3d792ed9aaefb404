"""Deterministic sharded WARC archives of pages, and a reader for them.

Writing: the smallest page_id of each payload digest writes the payload (a ``response``), other pages with it
point there (``revisit``). Records are range-sorted by page_id; each range partition writes its own gzip files,
one member a record, and begins a new file when the compressed size passes ``roll_bytes``. A file is written
under a name of the attempt and renamed when whole; only files that the manifest lists belong to the archive,
and the manifest itself comes last, by rename. The same pages give the same bytes: dates are a parameter, record
ids are hashes, gzip headers carry no time. A retried task writes its files again under the same final names.

Files go through ``pyarrow.fs``, so the target may be any store it opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.storage import discard, materialize

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "MANIFEST.json"
TASK_BYTES = 256 << 20
NAMESPACE = uuid.UUID(int=0)
FILES = "file string, records long, bytes long, sha256 string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None, url: str | None) -> str:
    return "".join(c for c in (url or "") if c > " " and c != "\x7f") or f"urn:page:{page_id}"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_uri: str | None, date: str) -> bytes:
    """One WARC/1.1 record, headers regenerated from the payload."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(page_id, url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Refers-To-Target-URI", refers_uri or "")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    return gzip.compress(data, compresslevel=level, mtime=0)


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Spark-style URI (``file:/x`` and bare paths included)."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_archive(pages: DataFrame, target: str, roll_bytes: int = 64 << 20, partitions: int | None = None, level: int = 6, date: str = "2024-01-01T00:00:00Z", min_payload: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``target``; returns the manifest (file, records, bytes, sha256).

    A null html is the empty payload; payloads shorter than ``min_payload`` are never revisits. Rows with a null
    page_id are responses of their own and never referred to. Repeated ids: equal payloads under one id are all
    responses. An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.filter("page_id IS NOT NULL").select("page_id", "url", F.sha1("payload").alias("digest"), F.length("payload").alias("n"))
    keyed = materialize(keyed, "warc-digests")
    first = keyed.filter(F.col("n") >= min_payload).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = materialize(first, "warc-first")  # written before it is joined, so that AQE can split a hot payload
    marks = keyed.select("page_id", "digest").join(first, "digest").filter(F.col("page_id") != F.col("first.page_id"))
    marks = marks.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_uri")).distinct()
    # marks and pages meet by sorting: each page's marks come just before it, and the payload is shuffled once
    none = lambda kind: F.lit(None).cast(kind)
    both = marks.select("page_id", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "digest", "refers_to", "refers_uri").unionByName(
        rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.sha1("payload").alias("digest"), none("long").alias("refers_to"), none("string").alias("refers_uri"))
    )
    if partitions is None:  # a task's share of the payloads stays the same however large the table is
        total = keyed.agg(F.sum("n")).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    placed = both.repartitionByRange(partitions, "page_id").sortWithinPartitions("page_id", "kind", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, root = resolve(target)
        fs.create_dir(root, recursive=True)
        done, at, held = [], None, {}
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["page_id"] != at:
                    at, held = r["page_id"], {}
                if not r["kind"]:
                    held[r["digest"]] = (r["refers_to"], r["refers_uri"])
                    continue
                refers = held.get(r["digest"], (None, None))
                data = member(record(r["page_id"], r["url"], r["payload"], *refers, date), level)
                if out is not None and out.size and out.size + len(data) > roll_bytes:
                    done.append(out.close())
                    out = None
                if out is None:
                    out = _Shard(fs, root, f"part-{context.partitionId():06d}-{len(done):04d}.warc.gz", attempt)
                out.add(data)
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    files = materialize(placed.mapInArrow(run, FILES), "warc-files")
    discard(keyed, first)
    _commit(files, target)
    return files


class _Shard:
    def __init__(self, fs: pafs.FileSystem, root: str, name: str, attempt: str):
        self.fs, self.final, self.name = fs, f"{root}/{name}", name
        self.temporary = f"{root}/_tmp-{attempt}-{name}"
        self.stream = fs.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.sha = 0, 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> dict:
        self.stream.close()
        _replace(self.fs, self.temporary, self.final)
        return {"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def _replace(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Rename; an earlier attempt of the task may have left the same bytes there."""
    try:
        fs.move(source, target)
    except OSError:
        fs.delete_file(target)
        fs.move(source, target)


def _commit(files: DataFrame, target: str) -> None:
    """Write the manifest under a temporary name and rename it, then drop what lost attempts left. It has a line for
    each file, not for each record."""
    fs, root = resolve(target)
    fs.create_dir(root, recursive=True)
    listed = sorted((r.asDict() for r in files.toLocalIterator()), key=lambda r: r["file"])
    with fs.open_output_stream(f"{root}/_tmp-{MANIFEST}", compression=None) as f:
        f.write(json.dumps({"files": listed}, indent=0).encode())
    _replace(fs, f"{root}/_tmp-{MANIFEST}", f"{root}/{MANIFEST}")
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.base_name.startswith("_tmp-"):
            fs.delete_file(info.path)


def records_of(stream: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip file with a member for each record."""
    buffer, inflate, data = b"", zlib.decompressobj(31), []
    for chunk in stream:
        buffer += chunk
        while buffer:
            data.append(inflate.decompress(buffer))
            buffer = inflate.unused_data
            if not inflate.eof:
                break
            yield _parse(b"".join(data))
            inflate, data = zlib.decompressobj(31), []
    if any(data):
        raise ValueError("the file ends inside a record")


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if headers.get("WARC-Block-Digest", f"sha1:{sha1_base32(block)}") != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"block digest differs in {headers.get('WARC-Record-ID')}")
    return headers, block


def read_archive(spark: SparkSession, target: str) -> DataFrame:
    """One row per record of the files in the manifest: page_id, url, record_type, payload (null for revisits),
    payload_bytes, payload_digest, refers_to. Digests are checked; a bad record fails the read."""
    fs, root = resolve(target)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        names = [x["file"] for x in json.loads(f.read())["files"]]
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = resolve(target)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for headers, block in records_of(iter(lambda: f.read(1 << 20), b"")):
                        rows.append(_row(headers, block))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.createDataFrame([(x,) for x in names], "file string")
    return files.repartition(max(1, min(len(names), 10_000))).mapInArrow(run, schema)


def _row(headers: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if revisit:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    else:
        size = len(payload)
        if sha1_base32(payload) != digest:
            raise ValueError(f"payload digest differs in {headers['WARC-Record-ID']}")
    number = lambda k: int(headers[k]) if k in headers else None
    return {"page_id": number("WARC-Page-ID"), "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"], "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To-Page-ID")}
