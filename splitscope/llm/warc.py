"""Operator 4 - deterministic sharded WARC writer and reader.

Pages are range-sorted by id into shards, each shard is written by one task of its own as gzip members (one per record),
and a file rolls when its compressed size reaches the limit.  Headers and digests are made anew
from the payload.  Shard borders come from exact prefix sums over the sorted ids and digests, so the same pages give the same files
byte for byte, wherever and however often tasks run.  Tasks look up the shard of a row among the borders, one for each shard.

Commit: a task attempt writes only under names of its own; the names that the successful attempts report form
the manifest, which Spark writes; then each file is renamed to its final name (again a Spark job, safe to
repeat) and the reader opens nothing but files of the manifest.  Lost executors leave orphans under
``_temporary``, which the commit removes.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the smallest id is the response, the others are
revisits that keep the HTTP head and refer to it.

Defined results: null html is the empty payload (a response); a null url is written as the empty target; rows with a null
id are written first, each as a response; of repeated rows with equal id and payload one is the
response and the others revisit it under the same id; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lean
from .common import cut, scratch_path, shuffle_width

MIN_REVISIT = 100
_STEP = 1 << 12
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_MANIFEST = "shard long, seq long, temp string, name string, records long, bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id: int | None, digest: str, kind: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{kind}/{copy}')}>"


def _member(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int, level: int) -> bytes:
    """One WARC record as one gzip member without time stamp."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest, kind, copy)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest, 'response', 0)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """The files of the shards of one task attempt."""

    def __init__(self, root: str, roll: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.attempt, self.roll = uuid.uuid4().hex, roll
        self.out, self.shard, self.seq, self.done = None, None, 0, []

    def add(self, shard: int, member: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.bytes + len(member) > self.roll and self.records):
            self.close()
        if shard != self.shard:
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.temp = f"_temporary/{self.attempt}/{shard:06d}-{self.seq:05d}.warc.gz"
            self.fs.create_dir(f"{self.root}/_temporary/{self.attempt}", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temp, f"part-{self.shard:06d}-{self.seq:05d}.warc.gz", self.records, self.bytes, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def shard_borders(metas: DataFrame, shard_bytes: int) -> list[tuple[int | None, bytes]]:
    """The first ``(page_id, d)`` of every shard of about ``shard_bytes``, in order (null ids come first).

    The keys are sorted by range and their bytes summed up: in each range by a window, over the ranges by one row each.  A border depends on the
    data alone, not on how it is partitioned, and even rows without an id are cut, by digest."""
    width = shuffle_width(metas.sparkSession)
    keys = metas.groupBy("page_id", "d").agg(F.sum("n").alias("n")).repartitionByRange(width, F.asc_nulls_first("page_id"), "d")
    keys = cut(keys.withColumn("part", F.spark_partition_id()), "warc-keys")
    order = keys.groupBy("part").agg(F.min(F.struct("page_id", "d")).alias("first"), F.sum("n").alias("n")).orderBy("first").collect()  # a row per range
    before, total = [], 0
    for r in order:
        before.append((r["part"], total))
        total += r["n"]
    if not before:
        return []
    starts = metas.sparkSession.createDataFrame(before, "part int, before long")
    up = Window.partitionBy("part").orderBy(F.asc_nulls_first("page_id"), "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = keys.join(F.broadcast(starts), "part").withColumn("at", F.col("before") + F.sum("n").over(up) - F.col("n"))
    first = at.groupBy(F.floor(F.col("at") / F.lit(shard_bytes)).alias("shard")).agg(F.min(F.struct("page_id", "d")).alias("first"))
    return [(r["first"]["page_id"], bytes(r["first"]["d"])) for r in first.orderBy("shard").collect()]  # a row per shard


def shard_of(borders: list[tuple[int | None, bytes]]):
    """A column function: the shard of (page_id, hex digest)."""
    digests = [d for _, d in borders]
    nulls = sum(i is None for i, _ in borders)
    ids = np.array([i for i, _ in borders if i is not None], dtype=np.int64)

    @F.arrow_udf("int")
    def shard(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        missing = page_id.is_null().to_numpy(zero_copy_only=False)
        key = page_id.fill_null(0).to_numpy()
        lo, hi = np.searchsorted(ids, key, side="left") + nulls, np.searchsorted(ids, key, side="right") + nulls
        lo[missing], hi[missing] = 0, nulls
        out = lo - 1  # the shard that begins before this id
        for k in np.flatnonzero(hi > lo).tolist():  # shards that begin at this id: its digest decides
            out[k] = bisect.bisect_right(digests, bytes.fromhex(digest[k].as_py()), int(lo[k]), int(hi[k])) - 1
        return pa.array(np.maximum(out, 0), pa.int32())

    return shard


def write_warc(pages: DataFrame, root: str, roll_bytes: int = 64 << 20, shard_bytes: int = 128 << 20, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``root`` and return the committed manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    metas = cut(rows.select("page_id", F.unhex("digest").alias("d"), "n"), "warc-meta")
    first = cut(metas.where(F.col("n") >= MIN_REVISIT).groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("d").alias("fd"), "first"), "warc-first")
    revisits = metas.where(F.col("n") >= MIN_REVISIT).join(first, F.col("d") == F.col("fd")).where("page_id > first").select("page_id", F.lower(F.hex("d")).alias("digest"), F.col("first").alias("refers_to")).distinct()
    borders = shard_borders(metas, shard_bytes)
    shard, n_shards = shard_of(borders)("page_id", "digest"), max(1, len(borders))
    null = lambda kind: F.lit(None).cast(kind)
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", null("long").alias("refers_to")).unionByName(revisits.select("page_id", "digest", F.lit(0).alias("kind"), null("string").alias("url"), null("string").alias("html"), "refers_to"))
    sorted_rows = both.withColumn("shard", shard).repartitionById(n_shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, same, refers, copy = _Files(root, roll_bytes), None, None, 0
        for batch in batches:
            for page_id, digest, kind, url, html, to, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page_id, digest) != same:
                    same, refers, copy = (page_id, digest), None, 0
                if kind == 0:
                    refers = to
                    continue
                data = html.encode()
                fresh = hashlib.sha256(data).hexdigest()
                if refers is None and copy and len(data) >= MIN_REVISIT and page_id is not None:
                    refers = page_id
                files.add(at, _member("response" if refers is None else "revisit", page_id, url, data, fresh, refers, copy, level))
                copy += 1
        files.close()
        if files.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files.done, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    spark_fs, base = pafs.FileSystem.from_uri(root)
    spark_fs.create_dir(base, recursive=True)
    manifest = cut(sorted_rows.mapInArrow(lean.batches(run), _MANIFEST), "warc-manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for x in batch.to_pylist():
                if fs.get_file_info(f"{base}/{x['temp']}").type == pafs.FileType.File:
                    fs.move(f"{base}/{x['temp']}", f"{base}/{x['name']}")
                got = fs.get_file_info(f"{base}/{x['name']}")
                if got.size != x["bytes"]:
                    raise OSError(f"{x['name']} holds {got.size} bytes, the manifest says {x['bytes']}")
            yield batch

    manifest.mapInArrow(lean.batches(commit), _MANIFEST).write.mode("overwrite").parquet(f"{root}/_manifest")
    if spark_fs.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:
        spark_fs.delete_dir(f"{base}/_temporary")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records_of(blob: bytes) -> Iterator[dict]:
    """The records of one archive file."""
    view, at = memoryview(blob), 0
    while at < len(view):
        z, parts, step = zlib.decompressobj(31), [], _STEP
        while not z.eof:  # in steps: what follows a member is copied each time, so it must stay small
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(z.decompress(view[at : at + step]))
            at, step = min(len(view), at + step), 2 * step
        at -= len(z.unused_data)
        data = b"".join(parts)
        f, block = _parse(data)
        if f["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"block digest of {f['WARC-Record-ID']} differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        kind = f["WARC-Type"]
        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else f["WARC-Payload-Digest"].removeprefix("sha256:")
        yield {"page_id": int(f["X-Page-Id"]) if f["X-Page-Id"] else None, "url": f["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(f["X-Refers-To-Page-Id"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The records of the committed files.  A file is one row of Spark's binary source, bounded by the roll size."""
    wanted = [x.split()[0] for x in _RECORDS.split(", ")][: 7 if payload else 6]
    schema = ", ".join(_RECORDS.split(", ")[: 7 if payload else 6])
    listed = spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest").select("name")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: len(wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                held, size = [], 0
                for r in records_of(blob.as_py()):
                    held.append({k: r[k] for k in wanted})
                    size += len(r["payload"] or b"") if payload else 64
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    # names of the manifest are few and the join keeps whole files, so the small side is the manifest
    return files.join(listed, "name", "left_semi").select("content").mapInArrow(lean.batches(run), schema)


def round_trip(pages: DataFrame, roll_bytes: int = 16 << 20, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write the pages, read the archives back and return what the records say."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    write_warc(pages, root, roll_bytes, shard_bytes)
    return read_warc(spark, root, payload=False).drop("url")
