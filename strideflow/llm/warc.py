"""WARC archives: written by Spark, indexed first, then read back by coalesced byte ranges.

``write_archives`` lays out one WARC/1.1 record per page as text and lets Spark's text writer put the records
of each partition into one archive; the separator between lines of that writer is the end of a record,
so the files are plain WARC. Equal payloads are found from digests and ids; the payloads themselves only move
when the list of shared digests is too long to broadcast.
``build_index`` walks each archive from header to header and writes offset, length, URL and digest per record.
``read_records`` takes any selection of index rows, sorts them by archive and offset, coalesces neighbours into
single range reads and cuts the records out again.

Archives go to a folder that all executors share; ranges are read through ``pyarrow.fs``, which opens local,
HDFS, S3 and GCS paths.

Defined results: a null html is an empty payload; a null or odd URL is written percent-encoded or left out; a null
page id is written as no id and read back as null; rows that tie for the largest id of a payload (repeated rows) are
all responses; copies whose ids are all null are all responses; a payload of any length is one record, read by one range. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.llm.common import bounded
from strideflow.session import scratch_path, stage

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # archives of the same pages are the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A range read holds at most so many bytes unless one record is longer; gaps up to so many bytes are read over.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
# Index rows are dealt to tasks by stretches of so many bytes of an archive.
STRETCH_BYTES = 32 << 20
# A header is read with so many bytes, or with so many after a short record.
HEADER_BYTES, AHEAD_BYTES = 16 << 10, 2 << 20

INDEX = "archive string, offset long, length long, url string, digest string, page_id string, record_type string"
RECORD = "archive string, offset long, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload (string), payload_bytes, payload_digest, record_type, refers_to, one row per page.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest id is the response.
    The largest id per digest is aggregated before it is shuffled, and only digests that occur more than
    once are joined back; a very frequent digest is one row on that side, so Spark can split the other.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    shared = stage(
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
        .select("payload_digest", "first_id"),
        "shared-payloads",
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(bounded(shared), "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _line(name: str, value: Column | str) -> Column:
    """A header line, or nothing for a null value."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_text(records: DataFrame) -> Column:
    """The whole record without the two line ends that close it."""
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    uuid = F.regexp_replace(
        F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "payload_digest", "url").cast("binary")),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5",
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        _line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        _line("Content-Type", "application/http; msgtype=response"),
        F.lit("Content-Length: "), block_bytes.cast("string"), F.lit(END),
        http, F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(records: DataFrame, path: str) -> None:
    """One archive per partition of ``records``; each value is one record, each separator its end."""
    records.select(record_text(records).alias("value")).write.option("lineSep", END).text(path)


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:80]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def _digest(head: dict[str, str]) -> str:
    return head["WARC-Payload-Digest"].removeprefix("sha1:")


def walk(file: pa.NativeFile, size: int) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and header of each record. Short records come many to a read; the blocks of long ones are skipped."""
    end_of_header = END.encode()
    offset, base, held, length = 0, 0, b"", 0
    while offset < size:
        want = HEADER_BYTES if 4 * length > AHEAD_BYTES else AHEAD_BYTES
        stop = held.find(end_of_header, offset - base) if offset < base + len(held) else -1
        while stop < 0:
            base, held = offset, file.read_at(min(want, size - offset), offset)
            stop = held.find(end_of_header)
            if stop < 0 and want >= size - offset:
                raise ValueError(f"unfinished record at {offset}")
            want *= 4
        head = _header(held[offset - base:stop])
        length = base + stop - offset + 4 + int(head["Content-Length"]) + 4
        yield offset, length, head
        offset += length


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path else (pafs.LocalFileSystem(), path)


def _index_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            fs, name = _open(path)
            rows: list[tuple] = []
            with fs.open_input_file(name) as file:
                for offset, length, head in walk(file, size):
                    rows.append((path, offset, length, head.get("WARC-Target-URI"), _digest(head), head.get("X-Page-Id"), head["WARC-Type"]))
                    if len(rows) >= 10_000:
                        yield _batch(rows, INDEX)
                        rows = []
            yield _batch(rows, INDEX)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def build_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Write and reread the index of all archives below ``path``; each archive is walked by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    files = files.where("length > 0")
    # A number of its own: the rows are tiny and would be put into one task, the archives are not.
    tasks = max(spark.sparkContext.defaultParallelism, files.count())
    files.repartition(tasks, "path").mapInArrow(_index_files, INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def coalesced(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Neighbouring ``(offset, length)`` in ascending order as ``(start, end, members)``."""
    start = end = 0
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - end > GAP_BYTES or offset + length - start > RANGE_BYTES):
            yield start, end, held
            held = []
        if not held:
            start = offset
        held.append((offset, length))
        end = max(end, offset + length) if len(held) > 1 else offset + length
    if held:
        yield start, end, held


def parse_record(raw: bytes) -> tuple:
    """page id, url, type, refers-to, payload bytes, payload digest and payload of one record.

    A response's size and digest are taken from the payload read and must agree with the header.
    """
    stop = raw.index(END.encode())
    head = _header(raw[:stop])
    block = raw[stop + 4:len(raw) - 4]
    payload = block[block.index(END.encode()) + 4:]
    size, digest = int(head["X-Payload-Bytes"]), _digest(head)
    if head["WARC-Type"] == "response":
        size, read = len(payload), hashlib.sha1(payload).hexdigest()
        if read != digest:
            raise ValueError(f"payload of page {head.get('X-Page-Id')} has digest {read}, not {digest}")
    return head.get("X-Page-Id"), head.get("WARC-Target-URI"), head["WARC-Type"], head.get("X-Refers-To-Page-Id"), size, digest, payload


def read_records(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``selected`` index rows point to; ``payloads=False`` leaves the bytes in the task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            by_archive: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(archives, offsets, lengths):
                by_archive.setdefault(archive, []).append((offset, length))
            for archive, rows in by_archive.items():
                fs, name = _open(archive)
                with fs.open_input_file(name) as file:
                    for start, end, members in coalesced(sorted(rows)):
                        block = file.read_at(end - start, start)
                        out = []
                        for offset, length in members:
                            *fields, payload = parse_record(block[offset - start:offset - start + length])
                            out.append((archive, offset, *fields, payload if payloads else None))
                        yield _batch(out, RECORD)

    spread = F.floor(F.col("offset") / F.lit(STRETCH_BYTES))
    held = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, held // STRETCH_BYTES)
    return (
        selected.select("archive", "offset", "length").repartition(tasks, "archive", spread)
        .sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD)
    )


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write archives of ``pages``, index them, read every record back: its digest, size, type and reference."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(page_records(pages, least_bytes), f"{path}/archives")
    index = build_index(spark, f"{path}/archives", f"{path}/index")
    kind = pages.schema["page_id"].dataType
    return read_records(index, payloads=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "url", "archive", "offset",
    )
