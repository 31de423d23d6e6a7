"""WARC archives in Zstandard: writer and reader.

An archive is one file. It begins with a skippable frame (magic 0x184D2A5D)
that holds the dictionary, itself a Zstandard frame; then follows one frame for
each record, compressed with that dictionary, so that a record can be read on
its own. Tasks write archives of bounded size straight to the shared folder,
under hidden names of their own attempt, and report the finished files in a
stored table; then a job over that table gives those files their visible names.
So the reader takes a folder, and a repeated task leaves no second copy in it.
The reader uses Spark's binary file source and validates magics, headers,
lengths, record ends and digests.

Records with equal payloads: the one with the largest page id is a response,
the others are revisits of it and carry no payload (identical-payload-digest
profile). Payloads smaller than ``least`` bytes are always responses.

Cases: ids are integers; a null payload is empty; null urls are written as an empty target; rows
that repeat an id are records of their own (all with the largest id are
responses); a null id is the smallest; an empty table gives no archive; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import dealt_anew, need_integers, shared_dir, stored

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 4 << 20
STEP = 1 << 16  # bytes that the reader gives to a frame at once
DICTIONARY_BYTES = 16 << 10
SAMPLE_PAGES, SAMPLE_BYTES = 400, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


class BadArchive(ValueError):
    """An archive that breaks the format, with the place where it does."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, code: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; for a revisit ``payload`` is not written."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + (payload or b"")
    clean = "".join(c for c in url or "" if c not in "\r\n")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Target-URI", clean),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{code}"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[1:1] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + CRLF + block + CRLF + CRLF


def read_record(data: bytes) -> dict:
    """Fields of one record after validation."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise BadArchive("a record does not begin with a WARC header")
    fields = {}
    for line in data[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"a header line without a colon: {line[:60]}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise BadArchive(f"{name} is missing")
    length = int(fields["content-length"])
    block, tail = data[end + 4 : end + 4 + length], data[end + 4 + length :]
    if len(block) != length or tail != b"\r\n\r\n":
        raise BadArchive(f"the block of {fields['warc-record-id']} is not {length} bytes long")
    if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise BadArchive(f"the block digest of {fields['warc-record-id']} is wrong")
    head, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"], fields["http"] = payload, head
    code = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and digest(payload) != code:
        raise BadArchive(f"the payload digest of {fields['warc-record-id']} is wrong")
    stated = [int(x.split(b":")[1]) for x in head.split(CRLF) if x.lower().startswith(b"content-length:")]
    if fields["warc-type"] == "response" and stated != [len(payload)]:
        raise BadArchive(f"the payload length of {fields['warc-record-id']} is wrong")
    return fields


class ArchiveWriter:
    def __init__(self, out: io.BufferedIOBase, dictionary: bytes, level: int = 3) -> None:
        self.out, self.size = out, 0
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        self._write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._write(self.frames.compress(record))


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    if int.from_bytes(data[:4], "little") != DICTIONARY_MAGIC:
        raise BadArchive("the archive does not begin with a dictionary frame")
    size = int.from_bytes(data[4:8], "little")
    held = data[8 : 8 + size]
    if len(held) != size:
        raise BadArchive("the dictionary frame is cut off")
    if held[:4] == FRAME_MAGIC:
        held = zstandard.ZstdDecompressor().decompress(held)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    at = 8 + size
    while at < len(data):
        if data[at : at + 4] != FRAME_MAGIC:
            raise BadArchive(f"no frame begins at byte {at}")
        frame, parts, stop = reader.decompressobj(), [], at
        while not frame.eof:
            if stop >= len(data):
                raise BadArchive(f"the frame at byte {at} is cut off")
            try:
                parts.append(frame.decompress(memoryview(data)[stop : stop + STEP]))
            except zstandard.ZstdError as e:
                raise BadArchive(f"the frame at byte {at} is broken: {e}") from e
            stop = min(len(data), stop + STEP)
        at = stop - len(frame.unused_data)
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, payload_col: str, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the beginnings of a bounded sample of payloads; it
    decides how small archives get, not what they hold."""
    part = F.substring(F.coalesce(F.col(payload_col), F.lit("")), 1, SAMPLE_BYTES).cast("binary").alias("x")
    sample = [write_record(i, "https://", r[0], len(r[0]), digest(r[0]), None, False) for i, r in enumerate(pages.select(part).limit(SAMPLE_PAGES).collect())]
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:  # too few or too equal samples
        return b"".join(sample[:4]) or write_record(0, "https://", b"", 0, digest(b""), None, False)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write one record for each row into archives in a new folder, which is
    returned; its table ``_archives`` (name, records, bytes) lists them."""
    need_integers(pages, id_col)
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"code": F.sha1("payload"), "size": F.octet_length("payload")})
    newest = base.where(F.col("size") >= least).groupBy("code").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).where("copies > 1")
    base = base.join(dealt_anew(newest.select("code", "newest"), "code"), "code", "left")
    revisit = F.col("newest").isNotNull() & (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    base = base.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", F.unhex("code").alias("sha1"), F.when(revisit, F.col("newest")).alias("refers_to"), revisit.alias("revisit"))
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages, payload_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        out = writer = None
        name, records = "", 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([writer.size])], names=["name", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, size, sha1, refers_to, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or writer.size >= archive_bytes:
                    if writer is not None:
                        yield close()
                    name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = files.open_output_stream(f"{root}/.{name}", compression=None)
                    writer = ArchiveWriter(out, dictionary.value)
                writer.add(write_record(page_id, url, payload, size, base64.b32encode(sha1).decode(), refers_to, bool(again)))
                records += 1
        if writer is not None:
            yield close()

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:  # else shown by an earlier attempt
                    files.move(f"{root}/.{name}", f"{root}/{name}")
            yield batch.select([0])

    reported = f"{folder}/_archives"
    base.mapInArrow(run, "name string, records long, bytes long").write.parquet(reported)
    spark.read.parquet(reported).select("name").mapInArrow(show, "name string").write.format("noop").mode("overwrite").save()
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, payload (null for revisits), payload_digest,
    stated_bytes (as the record's HTTP header gives it), refers_to of all
    archives in a folder."""
    schema = "page_id long, url string, record_type string, payload binary, payload_digest string, stated_bytes long, refers_to long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows, held = [], 0
                for data in read_archive(content):
                    f = read_record(data)
                    again = f["warc-type"] == "revisit"
                    stated = [int(x.split(b":")[1]) for x in f["http"].split(CRLF) if x.lower().startswith(b"content-length:")][0]
                    rows.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], None if again else f["payload"], f["warc-payload-digest"].removeprefix("sha1:"), stated, _page(f["warc-refers-to"]) if again else None))
                    held += len(data)
                    if held > 8 << 20:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "record_type", "payload", "payload_digest", "stated_bytes", "refers_to"]
    pdf = pd.DataFrame(rows, columns=names)
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit
    takes the length from the response that it names, and must name one with
    its digest."""
    known = stored(records.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("own")), "records")
    target = known.where("record_type = 'response'").select(F.col("page_id").alias("target"), F.col("payload_digest").alias("same"), F.col("own").alias("full")).distinct()
    target = dealt_anew(target, "target")
    revisit = known.where("record_type = 'revisit'").join(target, (F.col("refers_to") == F.col("target")) & (F.col("payload_digest") == F.col("same")), "left")
    lost = F.raise_error(F.concat(F.lit("the target of a revisit is missing: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    revisit = revisit.select("page_id", F.coalesce("full", lost.cast("long")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    whole = known.where("record_type = 'response'").select("page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return whole.union(revisit)
