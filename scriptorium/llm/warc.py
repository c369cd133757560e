"""WARC archives compressed with a Zstandard dictionary, and their reader.

An archive is a Zstandard file: a leading skippable frame (magic 0x184D2A5D) holds the dictionary, then every WARC
record is a frame of its own, so a record can be read alone given its offset. Each archive's dictionary is built from
its first ``DICT_SAMPLE_BYTES`` of records, which is all that a task holds; of records too few or too small to train on
(below 16, or about 10 KB) the dictionary is their beginning as it is. A task begins another archive when one has
``ARCHIVE_BYTES``, so that each can be read back whole.

Records with equal payloads are written once: that with the largest page id is the ``response``, the others are
``revisit`` records without a payload that refer to it. Payloads are compared by SHA-256 and length. Pages are numbered
and written to the shared folder first; only numbers and digests are grouped and joined, payloads stay in the task that
reads them: neither a page that a third of the rows share nor a very common host is a hot key.

Files go through pyarrow's file systems (local, HDFS, S3, GCS), under a temporary name until they are whole, and named
by partition: a task that runs again replaces its files. Spark's ``binaryFile`` source reads them back.

Defined results: null html is an empty payload; a null url is written as ``about:blank``; a null page id comes before
all others; of repeated rows (same id and payload) one is the response; an empty table gives no archives and an empty
result; line ends in a url are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICT_BYTES = 64 << 10
DICT_SAMPLE_BYTES = 4 << 20
ARCHIVE_BYTES = 512 << 20
LEVEL = 3
SKIPPABLE = 0x184D2A5D  # fixed value: magic number of the frame that holds a dictionary
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value

_MANIFEST = "path string, records long, bytes long"
_READ = (
    "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _record_id(uid: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, str(uid)).urn}>"


def page_record(uid: int, page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None, keeper: tuple[int, int | None] | None, date: str) -> bytes:
    """``size`` and ``digest`` (SHA-1, base32) are the payload's. ``keeper``: uid and page id of the response that holds the
    payload, if this record revisits it and so has none."""
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if keeper else "response"),
        ("WARC-Record-ID", _record_id(uid)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", "" if page_id is None else page_id),
    ]
    if keeper:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(keeper[0])),
            ("X-Refers-To-Page-Id", "" if keeper[1] is None else keeper[1]),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    return _record(fields, http.encode() + (payload or b""))


class ArchiveWriter:
    """Writes one archive to a binary stream. Records wait until the dictionary can be trained."""

    def __init__(self, stream, level: int = LEVEL, dict_bytes: int = DICT_BYTES, sample_bytes: int = DICT_SAMPLE_BYTES):
        self.stream, self.level, self.dict_bytes, self.sample_bytes = stream, level, dict_bytes, sample_bytes
        self.waiting: list[bytes] = []
        self.held = self.records = self.written = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(record)
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= self.sample_bytes:
            self._start()

    def _start(self) -> None:
        # Below about ten times its size a dictionary doesn't pay, and too few samples can't be trained on.
        size = min(self.dict_bytes, self.held // 10)
        trained = None
        if size >= 1024 and len(self.waiting) >= 16:
            try:
                trained = zstandard.train_dictionary(size, self.waiting, k=512, d=8, level=self.level)
            except zstandard.ZstdError:  # samples that share nothing
                trained = None
        if trained is None:
            trained = zstandard.ZstdCompressionDict(b"".join(self.waiting)[: max(size, 8)] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = trained.as_bytes()
        self.stream.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.written += len(raw) + 8
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained)
        for record in self.waiting:
            self._put(record)
        self.waiting = []

    def _put(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.stream.write(frame)
        self.written += len(frame)

    def close(self) -> None:
        if self.compressor is None and self.waiting:
            self._start()


def _frame_end(data: memoryview, at: int) -> int:
    """The end of the Zstandard frame at ``at``: its header, its blocks, its checksum if any."""
    checksum = data[at + 4] & 4
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + (4 if checksum else 0)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    data = memoryview(archive)
    if not len(data):
        return
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])))
    at = 8 + size
    while at < len(data):
        end = _frame_end(data, at)
        head, _, rest = decompressor.decompress(data[at:end]).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("a frame isn't a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        yield fields, rest[: int(fields["Content-Length"])]
        at = end


def write(
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_least: int = 0,
    date: str = WARC_DATE,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Archives all rows under ``root`` (a URI). Returns the manifest: ``path, records, bytes`` of each archive."""
    root = common.qualified(pages.sparkSession, root)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = common.materialise(
        pages.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).cast("long").alias("page_id"),
            F.col(url_col).alias("url"),
            payload.alias("payload"),
            F.struct(F.unhex(F.sha2(payload, 256)).alias("sha"), F.octet_length(payload).alias("size")).alias("digest"),
        ),
        "warc-rows",
        "zstd",
    )
    slim = rows.select("uid", "page_id", "digest").where(F.col("digest.size") >= revisit_least)
    keepers = slim.groupBy("digest").agg(F.max(F.struct("page_id", "uid")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    revisits = (
        slim.join(keepers.where("n > 1"), "digest")
        .where("uid <> keeper.uid")
        .select("uid", F.col("keeper.uid").alias("keeper_uid"), F.col("keeper.page_id").alias("keeper_id"))
    )
    revisits = common.materialise(revisits, "warc-revisits")
    # A revisit has no payload, so what is joined is small; responses stay where they are.
    sha1 = F.sha1("payload")
    again = common.maybe_among(rows.select("uid", "page_id", "url", F.col("digest.size").alias("size"), sha1.alias("sha1")), F.col("uid"), revisits.select("uid"))
    none = F.lit(None)
    again = again.join(revisits, "uid").select("uid", "page_id", "url", "size", "sha1", none.cast("binary").alias("payload"), "keeper_uid", "keeper_id")
    first = common.without(rows.select("uid", "page_id", "url", F.col("digest.size").alias("size"), sha1.alias("sha1"), "payload"), "uid", revisits.select("uid"))
    decided = first.withColumns({"keeper_uid": none.cast("long"), "keeper_id": none.cast("long")}).unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        records_ = (r for batch in batches for r in zip(*batch.columns, strict=True))
        ahead = next(records_, None)
        for number in itertools.count():
            if ahead is None:
                return
            name = f"{task.partitionId():06d}-{number:04d}"
            final, part = f"{folder}/archive-{name}.warc.zst", f"{folder}/_part-{name}-{task.taskAttemptId()}"
            with fs.open_output_stream(part) as stream:
                writer = ArchiveWriter(stream, sample_bytes=min(DICT_SAMPLE_BYTES, archive_bytes))
                info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(-1 - (task.partitionId() << 16) - number)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                writer.add(_record(info, b"format: WARC File Format 1.1\r\n"))
                while ahead is not None and writer.written < archive_bytes:
                    uid, page_id, url, size, sha, payload, keeper_uid, keeper_id = (x.as_py() for x in ahead)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    keeper = (keeper_uid, keeper_id) if keeper_uid is not None else None
                    writer.add(page_record(uid, page_id, url, size, digest, payload, keeper, date))
                    ahead = next(records_, None)
                writer.close()
            fs.move(part, final)
            row = {"path": f"{root}/{os.path.basename(final)}", "records": writer.records, "bytes": fs.get_file_info(final).size}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return common.materialise(decided.mapInArrow(run, _MANIFEST), "warc-manifest")


def read(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """A row for each page record of the archives under ``root``; revisits have no payload of their own.

    A response whose payload doesn't match its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _READ.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                out: list[dict] = []
                held = 0
                for fields, block in records(content.as_py()):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x[16:]) for x in head.split(b"\r\n") if x[:16].lower() == b"content-length: ")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
                    number = lambda name: int(fields[name]) if fields.get(name) else None  # noqa: B023, E731
                    values = (number("X-Page-Id"), fields["WARC-Target-URI"], length, digest, kind, number("X-Refers-To-Page-Id"), payload if with_payload and kind == "response" else None)
                    out.append(dict(zip(names, values, strict=True)))
                    held += len(block)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, _ARROW)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(root)
    return files.select("content").mapInArrow(run, _READ)


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
