"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``; a bundle is a file of such frames
followed by a seek table (a skippable frame with the compressed and plain size of each frame and a footer, in the
public seekable format). An index maps each record to its bundle, its frame and its place within the plain frame, so one
record is read by decompressing one frame.

Records of equal payload of at least ``least_bytes`` bytes are written once: the one with the largest page_id is the
response, the others are revisits that refer to it. Copies are found by an aggregate over digests, which is reduced on the
map side, and the payloads of a large group stay spread over the tasks that read them.

A task writes its bundles under names of its own attempt and returns their index rows; the index is stored by Spark's
commit protocol. Bundles of lost or repeated attempts are in no index and are never read.

Defined cases: a null html is an empty payload; empty payloads and payloads below ``least_bytes`` are always responses; a null
page_id is written with an empty id and never chosen as the response of others unless the whole group has none; rows that
share id and payload are one response each (they are the same record); an empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import stored
from orderflow.session import scratch_path

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = (
    "bundle string, page_id bigint, frame int, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint"
)


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record; a revisit has headers only and names the record that has the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's headers, and the payload of a response, whose digest and length are computed anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    page = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    out = {
        "page_id": int(page) if page else None,
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload": None,
        "refers_to": None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["WARC-Payload-Length"]),
    }
    if out["record_type"] == "revisit":
        out["refers_to"] = int(fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
        return out
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha1(payload).hexdigest() != out["payload_digest"] or len(payload) != out["payload_bytes"]:
        raise ValueError(f"payload of page {page} does not match its digest")
    return out | {"payload": payload}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) size of each frame, from the footer of a bundle."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    table = data[-9 - 8 * count : -9]
    return [struct.unpack_from("<II", table, 8 * i) for i in range(count)]


#: Names that stores have among Hadoop's file systems, and among Arrow's.
STORES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "file": "file", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def address(folder: str) -> str:
    """The folder as Arrow's file systems name it: a path, ``file:/path`` and ``s3a://`` are the usual forms of a shared folder."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "file", folder
    if scheme not in STORES:
        raise ValueError(f"archives can be written to {', '.join(sorted(STORES))}, not to {scheme}")
    return f"{STORES[scheme]}://{rest[2:] if rest.startswith('//') else rest}"


def decisions(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` with ``payload`` (UTF-8), ``digest`` and ``refers_to`` (null for a response)."""
    own = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = (
        own.filter(F.length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("of"), "holder")
    )
    other = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return own.join(groups, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", "digest", F.when(other, F.col("holder")).alias("refers_to")
    )


def write_bundles(
    pages: DataFrame, folder: str, least_bytes: int = 1000, frame_bytes: int = 1 << 20, bundle_bytes: int = 128 << 20
) -> DataFrame:
    """Write all records under ``folder`` and return the stored index, one row a record."""
    folder = address(folder)
    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        out, name, frames, at = None, "", [], 0
        plain, members, rows = [], [], []
        filled = 0

        def end_frame():
            nonlocal at, filled
            if not members:
                return
            packed = press.compress(b"".join(plain))
            out.write(packed)
            for page_id, begin, length in members:
                rows.append((name, page_id, len(frames), at, len(packed), begin, length))
            frames.append((len(packed), filled))
            at += len(packed)
            plain.clear()
            members.clear()
            filled = 0

        def end_bundle():
            nonlocal out, at
            if out is None:
                return None
            end_frame()
            out.write(seek_table(frames))
            out.close()
            columns = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4])],
                names=["bundle", "page_id", "frame", "frame_at", "frame_bytes", "record_at", "record_bytes"],
            )
            out, at = None, 0
            frames.clear()
            rows.clear()
            return batch

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(5)]):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)  # frames are made here
                data = record(page_id, url, payload, digest, refers_to)
                members.append((page_id, filled, len(data)))
                plain.append(data)
                filled += len(data)
                if filled >= frame_bytes:
                    end_frame()
                    if at >= bundle_bytes:
                        yield end_bundle()
        if (last := end_bundle()) is not None:
            yield last

    return stored(decisions(pages, least_bytes).mapInArrow(write, INDEX), "warc-index")


RECORDS = (
    "page_id bigint, url string, record_type string, payload binary, refers_to bigint, payload_digest string, payload_bytes bigint"
)
_RECORD_KINDS = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]


def read_bundles(
    spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = True, task_bytes: int = 32 << 20
) -> DataFrame:
    """All indexed records, read back from the archives.

    Tasks get frames, not records or files: a frame is fetched once, by its place in the bundle. The number of tasks
    follows the bytes of the frames, which the index knows and the rows that name them do not show."""
    folder = address(folder)
    frames = index.groupBy("bundle", "frame", "frame_at", "frame_bytes").agg(
        F.collect_list(F.struct("record_at", "record_bytes")).alias("places")  # bounded by the size of a frame
    )

    total = frames.agg(F.coalesce(F.sum("frame_bytes"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / task_bytes))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, _, at, length, places in zip(*[c.to_pylist() for c in batch.columns]):
                with system.open_input_file(f"{root}/{bundle}") as file:
                    data = unpress.decompress(file.read_at(length, at))
                records = [parse_record(data[p["record_at"] : p["record_at"] + p["record_bytes"]]) for p in places]
                names = ["page_id", "url", "record_type", "payload", "refers_to", "payload_digest", "payload_bytes"]
                if not with_payload:
                    records = [r | {"payload": None} for r in records]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in records], kind) for n, kind in zip(names, _RECORD_KINDS)], names=names
                )

    return frames.repartition(tasks, "bundle", "frame").mapInArrow(load, RECORDS)


def archive(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write the archives into a fresh shared folder and read all records back, without their payloads."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    index = write_bundles(pages, folder, least_bytes)
    return read_bundles(spark, folder, index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ARCHIVE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p),
g as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as holder from d)
select page_id, payload_bytes, payload_digest, case when page_id = holder then 'response' else 'revisit' end as record_type,
       case when page_id <> holder then holder end as refers_to
from g
"""
