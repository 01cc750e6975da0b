"""WARC records in seekable Zstandard bundles.

Each bundle file holds independent Zstandard frames of whole records and a footer frame with the
seek table (skippable frame 0x184D2A5E; per frame the compressed and plain size; count, flags,
0x8F92EAB1), so ordinary tools read it and ours jumps to a frame. The index maps a record id to
bundle, frame, and the record's offset within the frame.

Of records with equal payloads the one with the largest id is written in full; the others are revisits
that point at it. That is decided on ids and digests, grouped with partial sums, so a payload that a
third of all pages share is no single task. Revisits are written from these; payloads are only read
for responses, and meet the decisions in one join, the same at every size. Bundles get their final name
only when whole, and it holds the task's attempt, as the index does: so a task that runs again or twice
never touches a file that an index names. The index table is written before anything is read back.

Null payloads are empty; a null url is written as empty; repeated rows are records of their own
(equal ids and payloads: one response, the others revisit its id); empty tables give no rows; other
columns are not read. Payloads of any length are one frame at least of their own record's size.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

#: fixed values of the seekable format
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, offset_in_frame long, record_bytes long"


def record_id(page_id: int | None, digest: str, copy: str = "") -> str:
    """copy tells records of one page and payload apart: empty for the response, else url and number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url: str, payload: bytes | None, digest: str, size: int, refers_to, rid: str) -> bytes:
    """A response with its payload, or without one a revisit of refers_to."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {rid}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Collects records to frames, and writes the seek table at the end."""

    def __init__(self, out):
        import zstandard

        self.out, self.zstd, self.frames, self.buffer, self.held, self.at = out, zstandard.ZstdCompressor(level=3, write_checksum=True), [], [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in it) of a record."""
        place = len(self.frames), self.held
        self.buffer.append(raw)
        self.held += len(raw)
        if self.held >= FRAME_BYTES:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.buffer:
            packed = self.zstd.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((self.at, len(packed), self.held))
            self.at += len(packed)
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", packed, plain) for _, packed, plain in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class BundleReader:
    """Reads single frames of a bundle by its footer."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end")
        self.file.seek(size - 9 - 8 * count)
        sizes = struct.iter_unpack("<II", self.file.read(8 * count))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed), max_output_size=plain)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, bundle_bytes: int):
    """Rows (page_id, url, html, digest, bytes, refers_to, copy) to bundles in folder; yields their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        context, count, writer, names = TaskContext.get(), 0, None, INDEX.replace(",", "").split()[::2]

        def finish():
            writer.close()
            writer.out.close()
            store.move(temporary, final)
            rows = [(p, r, f"{folder}/{final.rsplit('/', 1)[1]}", f, writer.frames[f][0], writer.frames[f][1], o, n) for p, r, f, o, n in index]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to, copy = (c[i].as_py() for c in batch.columns)
                if writer is None:
                    final = f"{base}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{count:04d}.warc.zst"
                    temporary = f"{final}.part"
                    writer, index, count = BundleWriter(store.open_output_stream(temporary)), [], count + 1
                name = base64.b32encode(digest).decode()
                rid = record_id(page_id, name, copy)
                raw = make_record(page_id, url, None if html is None else html.encode(), name, size, refers_to, rid)
                index.append((page_id, rid, *writer.add(raw), len(raw)))
                if writer.at >= bundle_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows, those of a bundle in frame order, to the records' columns."""
    bundle = reader = frame = data = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["bundle"] != bundle:
                if reader:
                    reader.file.close()
                store, path = _open(bundle := row["bundle"])
                reader, frame = BundleReader(store.open_input_file(path), store.get_file_info(path).size), None
            if row["frame"] != frame:
                frame, data = row["frame"], reader.frame(row["frame"])
            headers, payload = read_record(data[row["offset_in_frame"] : row["offset_in_frame"] + row["record_bytes"]])
            if headers["WARC-Record-ID"] != row["record_id"]:
                raise ValueError(f"record {row['record_id']} is not where the index says")
            revisit = headers["WARC-Type"] == "revisit"
            number = lambda s: int(s) if s else None
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if not revisit and digest != payload_digest(payload):
                raise ValueError(f"payload of record {row['record_id']} is damaged")
            out.append((number(headers["X-Page-ID"]), headers["WARC-Target-URI"], int(headers["X-Payload-Length"]) if revisit else len(payload), digest, headers["WARC-Type"], number(headers.get("X-Refers-To-Page", "")), None if revisit else payload))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    if reader:
        reader.file.close()


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, bytes, refers_to, copy): html is null for revisits, refers_to for responses.

    Of pages whose id and payload repeat the one with the least url is the response or the first revisit.
    """
    scratch = Scratch(pages.sparkSession, "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    slim = rows.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("bytes"))
    groups = slim.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("c"), F.max("page_id").alias("last")).where("c > 1 AND last IS NOT NULL").select("digest", "last")
    each = slim.groupBy("page_id", "digest", "bytes").agg(F.count("*").alias("n"), F.min("url").alias("first_url")).join(groups, "digest", "left")
    responds = F.col("page_id").eqNullSafe(F.col("last"))
    # all that needs more than to be written as it is: revisits, and what they repeat if it has their id
    told = scratch.keep(each.where("last IS NOT NULL").withColumn("responds", responds).where("n > 1 OR NOT responds"), "told")
    told = told.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "last", "first_url", "responds")
    mine = F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest"))

    size, none = F.octet_length("html").cast("long").alias("bytes"), F.lit(None).cast("long").alias("refers_to")
    found = rows.join(told, mine, "left")
    # what nothing refers to may repeat too
    alone = F.when(F.col("page_id").isNull() | (F.octet_length("html") < least_bytes), F.concat_ws(" ", "url", F.monotonically_increasing_id())).otherwise("")
    single = found.where("of_digest IS NULL").select("page_id", "url", "html", "digest", size, none, alone.alias("copy"))
    repeated = found.where("responds").groupBy("page_id", "digest").agg(F.min("url").alias("url"), F.first("html").alias("html"))
    repeated = repeated.select("page_id", "url", "html", "digest", size, none, F.lit("").alias("copy"))

    # the others from ids and digests alone, as many as there are
    left = slim.groupBy("page_id", "url", "digest", "bytes").agg(F.count("*").alias("n")).join(told, mine)
    left = left.withColumn("n", F.col("n") - F.when(F.col("responds") & (F.col("url") == F.col("first_url")), 1).otherwise(0)).where("n > 0")
    again = left.select("page_id", "url", "digest", "bytes", "last", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    again = again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "bytes", F.col("last").alias("refers_to"), F.concat_ws(" ", "url", "k").alias("copy")).repartition(F.xxhash64("page_id", "copy"))
    return single.unionByName(repeated).unionByName(again)


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes *.warc.zst to folder (any URI that pyarrow opens) and gives the record index; run it once, keep the table."""
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    return plan_revisits(pages, least_bytes).mapInArrow(_write(folder, bundle_bytes), INDEX)


def read_bundles(index: DataFrame) -> DataFrame:
    """The records that an index names: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    rows = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset_in_frame")
    return rows.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives to the shared folder, keeps the index there, and gives what reading back returns."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    index = scratch.keep(write_bundles(pages, f"{scratch.folder}/bundles", least_bytes), "index")
    return read_bundles(index)
