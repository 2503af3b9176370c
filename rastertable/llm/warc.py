"""WARC archives: a deterministic writer in shards, and a reader.

Pages are range-sorted by id. Each task writes its range as a row of gzip files, one member per record, and begins a
new file when the compressed size passes a limit. Headers, record ids and digests are made anew from the page, so
another attempt of a task writes the same bytes. A file has a temporary name until it is complete; the manifest,
written last, names the files that count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2000-01-01T00:00:00Z"
LEAST_SHARED = 100
SALTS = 16
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def decisions(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``page_id``, ``payload_digest``, ``refers_to`` of the pages that repeat the payload of one with a smaller id.

    A payload shared by very many pages is one row of sums per task; its pages meet it under several salts.
    """
    long = pages.filter(F.col("payload_bytes") >= least)
    shared = (long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
              .filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
              .select("payload_digest", "refers_to", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    return (long.select("page_id", "payload_digest", salt.alias("salt")).join(shared, ["payload_digest", "salt"])
            .filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))
            .select("page_id", "payload_digest", "refers_to").distinct())


def write(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20, least: int = LEAST_SHARED) -> str:
    """Write ``page_id``, ``url`` and ``html`` of every row of ``pages`` below ``folder``, a new one; returns the manifest's path.

    Null html is an empty payload. Of equal payloads of at least ``least`` bytes, the page of smallest id is a response and
    those of larger or no id are revisits of it; pages that share the smallest id are all responses, and so are pages without
    an id if none has one. An empty table gives an empty manifest. Other columns are left out.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digested = base.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    # a decision travels as a row of its own ahead of its page, so that page bodies are shuffled once
    rows = base.withColumns({"payload_digest": F.sha2("payload", 256), "refers_to": F.lit(None).cast("long"), "page": F.lit(1)}).unionByName(
        decisions(digested, least).withColumn("page", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "payload_digest", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Files(folder, TaskContext.get().partitionId(), roll_bytes)
        decided, refers = None, None
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                page, digest = c["page_id"][i].as_py(), c["payload_digest"][i].as_py()
                if c["page"][i].as_py() == 0:
                    decided, refers = (page, digest), c["refers_to"][i].as_py()
                    continue
                out.add(record(page, c["url"][i].as_py(), c["payload"][i].as_buffer(), digest, refers if decided == (page, digest) else None))
        out.close()
        yield pa.RecordBatch.from_pylist(out.manifest, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = f"{folder}/manifest"
    rows.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return manifest


def urn(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page}:{digest}')}>"


def header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in str(v))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record(page: int | None, url: str | None, payload, digest: str, refers: int | None) -> bytes:
    """One record; a revisit keeps the head of the response and leaves the payload out."""
    payload = memoryview(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        block += payload
    return header([
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", urn(page, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", url), ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", None if refers is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if refers is None else urn(refers, digest)), ("X-Refers-To-Page-ID", refers),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


class Files:
    """Files of one task: gzip members, a new file past ``roll_bytes``, final names only for complete files."""

    def __init__(self, folder: str, task: int, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.task, self.roll_bytes, self.manifest, self.out = task, roll_bytes, [], None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.name = f"part-{self.task:06d}-{len(self.manifest):05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, -1, hashlib.sha256()
            info = b"software: training text archive writer\r\nformat: WARC File Format 1.1\r\n"
            self._member(header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, self.name)}>"), ("WARC-Date", DATE),
                                 ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")
        self._member(raw)
        if self.size >= self.roll_bytes:
            self.close()

    def _member(self, raw: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in (packer.compress(raw), packer.flush()):
            self.out.write(part)
            self.sha.update(part)
            self.size += len(part)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.manifest.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.out = None


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    unpacker, parts = None, []
    while data := stream.read(chunk):
        while data:
            unpacker = unpacker or zlib.decompressobj(31)
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = None, []
    if unpacker is not None:
        raise ValueError("the file ends within a record")


def parse(raw: bytes) -> dict:
    """Fields and block of a record, its block digest checked."""
    head, block = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[:int(fields["Content-Length"])]
    if (want := fields.get("WARC-Block-Digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a record's digest does not fit its block")
    return fields | {"block": block}


def read(spark: SparkSession, manifest: str) -> DataFrame:
    """The records (see ``RECORD``) of the files that the manifest names. Lengths and digests are those of the full payload;
    the payload of a revisit is null. A damaged or missing file is an error."""
    folder = manifest.rpartition("/")[0]
    files = spark.read.schema(MANIFEST).parquet(manifest)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields in map(parse, members(stream)):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(fields))
                        held += len(fields["block"])
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.repartition(max(1, files.count()), "file").mapInArrow(run, RECORD)


def _row(fields: dict) -> dict:
    number = lambda k: int(fields[k]) if k in fields else None
    head, _, payload = fields["block"].partition(b"\r\n\r\n")
    length = int(head.lower().split(b"content-length: ")[1].split(b"\r\n")[0])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not fit its header")
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
            "payload_bytes": length, "payload_digest": digest, "payload": payload if response else None}
