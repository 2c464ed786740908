"""Deterministic sharded WARC writer and reader.

Records are range-sorted, written by each task to temporary files that roll at a compressed size,
and become visible only when a second job renames the files that the committed manifest lists.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.common import runs
from mnemoloom.session import drop_folder, new_folder

#: All records carry one date, so that equal input gives equal archives.
RECORD_DATE = "2000-01-01T00:00:00Z"
#: Bins of ids for each shard, and how many bins in all are broadcast.
BINS, MAX_BROADCAST_BINS = 8, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temp string, name string, bytes long, records long, sha256 string"
READ = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string, payload binary"


def _record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, all its headers made anew from the row: length, digests, ids."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}:{copy}>",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)
        head.insert(3, f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:0>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class _Files:
    """The files that a task writes, shard after shard. Each record is a gzip member of its own; a file closes at ``roll`` bytes."""

    def __init__(self, root: str, roll: int) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(root)
        self.roll, self.attempt = roll, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.shard, self.seq, self.out, self.done = None, 0, None, []

    def begin(self, shard: int) -> None:
        self.close()
        self.shard, self.seq = shard, 0

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.temp = f"_temporary/{self.attempt}-{self.shard:06d}-{self.seq:05d}.tmp"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None), 0, 0, hashlib.sha256()
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temp, f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz", self.bytes, self.records, self.sha.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def _shards(every: DataFrame, ids: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """``every`` with a column ``shard``, and how many shards there are.

    Ids are counted in bins of equal width, BINS for each shard that the row count asks for; neighbouring bins make up a shard. The driver gets a few
    numbers for each file that will be written. Only ids that crowd into one bin make a larger shard (of more files).
    """
    low, high, total, known = ids.agg(F.min("page_id"), F.max("page_id"), F.count("*"), F.count("page_id")).first()
    nulls = -(-(total - known) // shard_rows)
    wanted = -(-known // shard_rows)
    by_digest = F.pmod(F.xxhash64("digest"), F.lit(max(nulls, 1))).cast("int")
    if wanted <= 1:
        return every.withColumn("shard", F.when(F.col("page_id").isNull(), by_digest).otherwise(nulls)), nulls + 1
    width = -(-(high - low + 1) // (wanted * BINS))
    bin_of = F.floor(F.col("page_id") / F.lit(width)) if width >= 1 << 53 else F.expr(f"page_id div {width}L")
    counts = ids.where("page_id is not null").groupBy(bin_of.alias("bin")).count().collect()
    shard, held, place = nulls, 0, []
    for b, n in sorted((r["bin"], r["count"]) for r in counts):
        if held and held + n > shard_rows:
            shard, held = shard + 1, 0
        held += n
        place.append((b, shard))
    table = ids.sparkSession.createDataFrame(place, "bin long, range int")
    # Two numbers for each of at most BINS bins a shard: broadcast while small, else joined by the shuffle that a larger table takes.
    table = F.broadcast(table) if len(place) <= MAX_BROADCAST_BINS else table
    found = every.withColumn("bin", bin_of).join(table, "bin", "left")
    return found.withColumn("shard", F.when(F.col("page_id").isNull(), by_digest).otherwise(F.col("range"))).drop("bin", "range"), shard + 1


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def write_warc(pages: DataFrame, root: str | None = None, min_revisit_bytes: int = 100, roll_bytes: int = 64 << 20, shard_rows: int = 4096) -> tuple[str, DataFrame]:
    """Write a WARC record for each row of ``pages`` (page_id, url, html); returns the folder and its manifest.

    The payload is html in UTF-8, empty for null. Of records with equal payloads of at least
    ``min_revisit_bytes`` that with the smallest page_id is a response and the others are revisits
    without payload. A shard holds a range of page_ids, some ``shard_rows`` records, in order (null ids have shards of their
    own, dealt by payload); its files are ``shard-p-n.warc.gz``, each closed once it holds ``roll_bytes`` compressed. Ranges come from exact
    counts of ids (see ``_shards``), so equal tables give equal files in any session.

    Defined cases: repeated (page_id, payload) rows are ordered as copies, the first of which is the
    response; a payload whose pages all have a null page_id is never a revisit; a null url has no
    target URI; columns other than the three are ignored; an empty table gives no files.

    Scale: payloads are shuffled once. Which records revisit is found on (page_id, digest) rows alone
    (a grouped minimum, combined before its shuffle, and a join that AQE can split) and is merged into
    the range sort as marker rows next to their records, so no payload meets a key of copies.
    """
    spark = pages.sparkSession
    root = root or new_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    marks = slim.distinct().join(first, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind"))
    every = rows.withColumns({"refers_to": F.lit(None).cast("long"), "kind": F.lit(1)}).unionByName(marks)
    dealt, n = _shards(every, pages.select(F.col("page_id").cast("long").alias("page_id")), shard_rows)
    dealt = dealt.repartitionById(n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, mark, copy = _Files(root, roll_bytes), (None, None), None, 0
        for batch in runs(batches, "payload"):
            for r in batch.to_pylist():
                if r["shard"] != files.shard:
                    files.begin(r["shard"])
                now = (r["page_id"], r["digest"])
                if now != key:
                    key, mark, copy = now, None, 0
                if r["kind"] == 0:
                    mark = r["refers_to"]
                    continue
                refers_to = None if mark is None or (mark == r["page_id"] and copy == 0) else mark
                files.write(_record(r["page_id"], copy, r["url"], r["payload"], r["digest"], refers_to))
                copy += 1
        files.close()
        yield _table(files.done, ["temp", "name", "bytes", "records", "sha256"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])

    # Only attempts that Spark commits appear in this table; what failed attempts wrote is never renamed.
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{root}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{path}/{r['temp']}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/{r['temp']}", f"{path}/{r['name']}")
            yield batch

    manifest.repartition(n).mapInArrow(rename, MANIFEST).write.parquet(f"{root}/_committed")
    drop_folder(spark, f"{root}/_temporary")
    return root, spark.read.schema(MANIFEST).parquet(f"{root}/_committed")


class _Checked:
    """A stream that counts and digests what is read of it."""

    def __init__(self, stream: io.RawIOBase) -> None:
        self.stream, self.bytes, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.bytes += len(data)
        self.sha.update(data)
        return data


def _members(stream: _Checked) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed, holding one at a time. A file that ends within one raises ValueError."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("the file ends within a record")
            return
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    if h["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"block digest of {h['WARC-Record-ID']} does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match")
    page = h["WARC-Record-ID"].split(":")[2]
    refers = int(h["WARC-Refers-To"].split(":")[2]) if revisit else None
    return (None if page == "null" else int(page), h["WARC-Type"], size, digest, refers, h.get("WARC-Target-URI"), None if revisit else payload)


def read_warc(root: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` lists, one row each; block and payload digests are checked, and of each file
    its length, number of records and SHA-256 against the manifest: a missing, cut or changed file is an error.

    A file is read as a stream, one record held at a time. ``payloads=False`` leaves the payload
    column null (it is still read and its digest checked).
    """
    names, types = [x.split()[0] for x in READ.split(", ")], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for entry in batch.to_pylist():
                rows, held, records = [], 0, 0
                with fs.open_input_stream(f"{path}/{entry['name']}", compression=None) as f:
                    stream = _Checked(f)
                    for member in _members(stream):
                        row = _parse(member)
                        records += 1
                        rows.append(row if payloads else (*row[:6], None))
                        held += len(member) if payloads else 100
                        if held > 4 << 20:
                            yield _table(rows, names, types)
                            rows, held = [], 0
                if (stream.bytes, records, stream.sha.hexdigest()) != (entry["bytes"], entry["records"], entry["sha256"]):
                    raise ValueError(f"{entry['name']} is not the file of the manifest")
                yield _table(rows, names, types)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "bytes", "records", "sha256").repartition(n).mapInArrow(read, READ)
