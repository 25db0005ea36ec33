"""WARC archives compressed with a dictionary of their own.

A Zstandard dictionary is trained on archived records, put into a leading
skippable frame of each archive (magic 0x184D2A5D, as in the public ``.warc.zst``
proposal), and every record is one frame compressed with it.  Any reader of
the archive finds the dictionary first, and a record can be read on its own.

Archives are written by Spark's text writer, so a lost executor or a repeated
task leaves nothing behind, in whatever store the path names.  A row is a whole
archive: a task fills one up to :data:`ARCHIVE_BYTES` and goes on with the next,
so neither writer nor reader holds more than one and a record.  What the text
writer puts after each row is an empty skippable frame, and it names the files
``part-*.txt``; their content is that of a ``.warc.zst`` file.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import drop, new_path, slices, stored

#: Records sampled (by hash, expected number; equal ones count once) to train the
#: dictionary on, and bytes taken of each payload, at a place that the hash
#: names; this bounds what the driver reads.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 8192
DICTIONARY, LEVEL = 65_536, 3
#: Bytes of an archive, after which the next one begins, and of the payloads that
#: a reader hands on at once.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 8 << 20
#: Magic number of the frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame (magic 0x184D2A50); ASCII, so that it can be the
#: line separator of Spark's text writer.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EMPTY = base64.b32encode(hashlib.sha1(b"").digest()).decode()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples of records; where they are too few or too
    much alike to train one, what there is as raw content, behind an empty
    record."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(1024, min(DICTIONARY, total // 8)), samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join([*samples, record("response", "", "", None, "http://", b"", EMPTY)])[-DICTIONARY:]


def _escaped(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(kind: str, id_: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, str | None] | None = None) -> bytes:
    """One WARC/1.1 record, ``id_`` its URN.  A revisit has the headers but not
    the payload, and names the page (id, url) that it repeats."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{id_}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if refers is not None:
        head += [f"X-Refers-To-Page: {refers[0]}", f"WARC-Refers-To-Date: {date}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_escaped(refers[1])}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def info_record(id_: str, date: str) -> bytes:
    """The record that an archive begins with."""
    body = b"software: querylens\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{id_}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, ``warcinfo`` included; the first frame
    must be a dictionary's."""
    if not data:
        return
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack_from("<II", data)[1]
    own = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=own).stream_reader(memoryview(data)[8 + size :], read_across_frames=True), 1 << 18)
    while first := source.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {first[:40]!r}")
        headers = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            headers[key] = value.strip()
        block = source.read(int(headers["Content-Length"]))
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


def _writer(dictionary: bytes, run_id: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, task, number = _compressor(dictionary).compress, TaskContext.get().partitionId(), 0
        frames: list[bytes] = []
        size = 0

        def name() -> str:
            return uuid.UUID(bytes=hashlib.md5(f"{run_id}/{task}/{number}".encode()).digest()).urn

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["archive"])

        for batch in slices(batches, 100):
            for row in zip(*(batch.column(i) for i in range(6))):
                page_id, url, payload, kind, refers_to, refers_url = (x.as_py() for x in row)
                if not frames:
                    frames = [dictionary_frame(dictionary), compress(info_record(name(), date))]
                    size, number = sum(map(len, frames)), number + 1
                refers = (refers_to, refers_url) if kind == "revisit" else None
                frames.append(compress(record(kind, name(), date, page_id, url, payload, digest_of(payload), refers)))
                size, number = size + len(frames[-1]), number + 1
                if size >= archive_bytes:
                    yield archive()
                    frames = []
        if frames:
            yield archive()

    return run


KINDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for data in batch.column(0):
                rows: list = []
                held = 0
                for headers, block in read_archive(data.as_buffer()):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    if payload is not None:  # what was archived is what is reported
                        size, digest = len(payload), digest_of(payload)
                    kept = payload if payloads else None
                    held += len(kept or b"")
                    rows.append((number(headers.get("X-Page-ID")), size, digest, kind, number(headers.get("X-Refers-To-Page")), kept))
                    if len(rows) >= 2000 or held >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS.values())], names=list(KINDS))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS.values())], names=list(KINDS))

    return run


def sampled_records(rows: DataFrame, date: str) -> list[bytes]:
    """Records of about :data:`SAMPLE_ROWS` of the rows (page_id, url, payload),
    chosen by a hash of all three, whatever their number and order."""
    n = rows.count()
    if not n:
        return []
    hashed = F.xxhash64("page_id", "url", "payload")
    start = F.pmod(hashed, F.greatest(F.octet_length("payload") - SAMPLE_BYTES, F.lit(1))) + 1
    chosen = rows.withColumn("h", hashed).where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30)))
    cut = chosen.select("h", F.substring("url", 1, SAMPLE_BYTES).alias("url"), F.substring(F.col("payload"), start.cast("int"), F.lit(SAMPLE_BYTES)).alias("part"))
    # copies count once, so that many of them are still one row
    found = cut.groupBy("h").agg(F.first("url").alias("url"), F.first("part").alias("part")).collect()
    return [record("response", uuid.UUID(int=r.h & (1 << 64) - 1).urn, date, r.h, r.url, bytes(r.part), EMPTY) for r in sorted(found, key=lambda r: r.h)]


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Archive every row of ``pages`` under ``path``, in files of about
    ``archive_bytes`` each; ``date`` (RFC 3339) is now unless given.

    The payload is the text in UTF-8 (null: empty).  Of records with equal
    payloads of at least ``min_bytes`` bytes, the one with the smallest id is
    the response and the others revisit it, all rows with that id being
    responses; smaller ones are all responses.  Rows with a null id revisit
    the smallest id of their payload, or are responses if there is none.
    Repeated rows are records each, with ids of their own; further columns don't
    matter; an empty table gives no archive.
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "utf-8"), F.expr("cast('' as binary)"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    dictionary = train_dictionary(sampled_records(rows, date))
    key = F.sha1("payload")
    # payloads that occur once need no look-up; a hot one is one row here
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("least")
    twice = rows.where(F.octet_length("payload") >= min_bytes).groupBy(key.alias("twice_key")).agg(first, F.count("*").alias("n"))
    twice = stored(twice.where("n > 1 and least is not null").select("twice_key", "least"), "payloads")
    told = rows.withColumn("key", key).join(twice, F.col("key") == F.col("twice_key"), "left")
    again = F.col("least").isNotNull() & ~F.coalesce(F.col("least.page_id") == F.col("page_id"), F.lit(False))
    told = told.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("least.page_id")).alias("refers_to"), F.when(again, F.col("least.url")).alias("refers_url"))
    archives = told.mapInArrow(_writer(dictionary, uuid.uuid4().hex, date, archive_bytes), "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)
    drop(twice)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)
    of each response and revisit under ``path``; a revisit's payload is null,
    and so are all without ``payloads``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(payloads), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages`` in the shared folder, and what the archives hold; for
    the rules, see :func:`write_archives`."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, page_id, url, payload, min_bytes, archive_bytes=archive_bytes)
    return read_archives(pages.sparkSession, path, payloads=False).drop("payload")


def oracle(pages: str = "pages", min_bytes: int = 0) -> str:
    """DuckDB SQL of :func:`archive_round_trip`."""
    five = "(('0x' || substr(h, 10 * (i // 8)::int + 1, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31"
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as b from {pages}),
d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
m as (select *, case when n >= {min_bytes} then min(page_id) over (partition by h) end as least from d)
select page_id, n::bigint as payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', (({five}) + 1)::int, 1)), '') as payload_digest,
case when least is null or least = page_id then 'response' else 'revisit' end as record_type,
case when least <> page_id then least end as refers_to from m"""
