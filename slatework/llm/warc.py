"""WARC archives, index first.

Writing: pages with equal payloads of some length are told apart by digest; the page with the smallest id of such a
group becomes a ``response`` record, the others ``revisit`` records that refer to it and hold no payload.  Every task
writes archives of its own, one gzip member per record, and hands out one index row per record: archive, offset,
length, URL and digest.  The index is an ordinary table and is committed by Spark: it names the archives of the
attempt that succeeded, so what a lost or repeated task wrote is never read.

Reading: index rows are selected like any table, dealt out by range of an archive, sorted by offset, and neighbours
with small gaps are fetched with one read.  Only the bytes of selected records (and those gaps) are read.

Archives lie wherever ``pyarrow`` finds a file system for the folder's URI.  A NULL payload is empty.  Payloads are
UTF-8.  Pages with NULL ids are never referred to: a group without any id is all responses, and a page without id in
a group with one revisits it.  All pages that hold the group's smallest id are responses.  NULL URLs give records
without a URI; characters that a header can't hold are escaped there and kept in the index.  Ids are read back from the
records as text; '' reads as NULL.  Extra columns are not written.  An empty table gives an empty index and no archive.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs

from pyspark.sql import DataFrame, SparkSession, functions as F

from slatework.llm.common import written
from slatework.llm.encoding import slices

#: Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URI_CHARACTERS = "!#$%&'()*+,-./:;=?@[]_~"
_ID = "urn:x-page:"
INDEX = "page_id string, url string, record_type string, refers_to string, payload_digest string, archive string, offset long, length long"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload binary"
_INDEX_NAMES = [f.split()[0] for f in INDEX.split(", ")]
_OUT_BYTES = 4 << 20


def _uri(folder: str) -> str:
    """``file:/x`` and ``/x`` as ``file:///x``; other URIs as they are."""
    path = folder.removeprefix("file:") if folder.startswith("file:") else folder
    return "file:///" + path.lstrip("/") if path.startswith("/") else folder


def _headed(fields: Sequence[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{name}: {value}".encode() for name, value in fields if value is not None], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + END + block + END


def _record_id(page_id: str | None) -> str:
    return f"<{_ID}{quote(page_id or '', safe='')}>"


def record(page_id: str | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None, date: str) -> bytes:
    """One record, not yet compressed: a response with its payload, or a revisit (``payload`` None) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe=URI_CHARACTERS)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if payload is None:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return _headed([*fields, ("Content-Type", "application/http; msgtype=response")], http + (payload or b""))


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = raw.partition(END)
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("no WARC record at this place")
    fields = {name.decode().lower(): value.strip().decode() for name, _, value in (line.partition(b":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != END:
        raise ValueError("the record's length and its content differ")
    return fields, rest[:size]


def _page_of(record_id: str | None) -> str | None:
    return unquote(record_id.removeprefix(f"<{_ID}").removesuffix(">")) or None if record_id else None


def _write(folder: str, archive_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        out, archive, offset = None, None, 0
        try:
            for whole in batches:
                for batch in slices(whole, "html"):
                    rows = []
                    for page, url, html, digest, size, first, revisit in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "first", "revisit")]):
                        if out is None or offset >= archive_bytes:
                            if out is not None:
                                out.close()
                            archive = f"{uuid.uuid4().hex}.warc.gz"
                            out = files.open_output_stream(f"{base}/{archive}", compression=None)
                            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")]
                            opening = gzip.compress(_headed(info, b"format: WARC File Format 1.1\r\n"), level, mtime=0)
                            out.write(opening)
                            offset = len(opening)
                        made = record(page, url, None if revisit else html.encode(), digest, size, first, date)
                        member = gzip.compress(made, level, mtime=0)
                        out.write(member)
                        rows.append((page, url, "revisit" if revisit else "response", first if revisit else None, digest, archive, offset, len(member)))
                        offset += len(member)
                    kinds = [pa.string()] * 6 + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 100, archive_bytes: int = 64 << 20, level: int = 4, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the pages under ``folder`` and return the index, itself written to ``folder``/index.

    Bodies are not shuffled as long as the groups of equal payloads fit the session's broadcast limit; beyond it they are
    joined by digest, and Spark splits a digest with many pages.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    held = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("html")).withColumns(
        {"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html").cast("long")}
    )
    groups = held.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    firsts = written(groups.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("__digest"), "first"))
    told = held.join(firsts, F.col("digest") == F.col("__digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = told.select(
        F.col("id").cast("string").alias("page_id"), "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"),
        "digest", "size", F.col("first").cast("string").alias("first"), revisit.alias("revisit"),
    )
    uri = _uri(folder)
    files, base = pa.fs.FileSystem.from_uri(uri)
    files.create_dir(f"{base}/archives", recursive=True)
    rows.mapInArrow(_write(f"{uri}/archives", archive_bytes, level, date), INDEX).write.parquet(f"{folder}/index")
    return open_index(pages.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(places: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """First and past-the-last record of each read: places are (offset, length) by offset, gaps of up to ``gap`` bytes are read over."""
    ends = np.maximum.accumulate(places[:, 0] + places[:, 1])
    cuts = np.flatnonzero(places[1:, 0] > ends[:-1] + gap) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]))


def _read(folder: str, gap: int):
    kinds = [pa.string()] * 5 + [pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, spans in zip(batch.column("archive").to_pylist(), batch.column("spans")):
                places = np.array([(s["offset"], s["length"]) for s in spans.as_py()], np.int64)
                rows, held = [], 0
                with files.open_input_file(f"{base}/{archive}") as source:
                    for begin, end in coalesced(places, gap):
                        start = int(places[begin, 0])
                        stop = int((places[begin:end, 0] + places[begin:end, 1]).max())
                        data = memoryview(source.read_at(stop - start, start))
                        for offset, length in places[begin:end].tolist():
                            fields, block = parsed(gzip.decompress(data[offset - start : offset - start + length]))
                            revisit = fields["warc-type"] == "revisit"
                            body = None if revisit else block.partition(END)[2]
                            uri = fields.get("warc-target-uri")
                            rows.append((_page_of(fields["warc-record-id"]), uri, fields["warc-type"], _page_of(fields.get("warc-refers-to")), fields["warc-payload-digest"].removeprefix("sha256:"), body))
                            held += len(block)
                            if held > _OUT_BYTES:
                                yield made(rows)
                                rows, held = [], 0
                if rows:
                    yield made(rows)

    return run


def read_records(index: DataFrame, folder: str, *, range_bytes: int = 8 << 20, gap: int = 64 << 10) -> DataFrame:
    """The records of the index rows given, read from the archives: page_id, url (as in the header), record_type, refers_to,
    payload_digest and payload (NULL for revisits).

    A read is at most ``range_bytes`` and a record long.  Ranges are dealt out by the bytes they stand for, a few to a task:
    their rows say nothing of the work, so Spark must not put many into one task for being small.
    """
    asked = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-asked // (2 * range_bytes)), min(64, -(-asked // (1 << 20))))
    placed = index.withColumn("range", F.floor(F.col("offset") / range_bytes)).repartition(tasks, "archive", "range")
    ranges = placed.groupBy("archive", "range").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spans")
    )
    return ranges.sortWithinPartitions("archive", "range").select("archive", "spans").mapInArrow(_read(f"{_uri(folder)}/archives", gap), RECORD)


def with_full_payload(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Records with values of the full payload, a revisit's being those of the response it refers to.

    ``columns`` names SQL expressions over ``payload``; they are worked out where the payload is read, so bodies are not
    shuffled.  Several responses of one id are taken as one.
    """
    narrow = written(records.select("page_id", "url", "record_type", "refers_to", "payload_digest", *[F.expr(e).alias(c) for c, e in columns.items()]))
    responses = narrow.where("record_type = 'response'").groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(*[F.first(c).alias(f"__of_{c}") for c in columns])
    revisits = narrow.where("record_type = 'revisit'").join(responses, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    full = revisits.select("page_id", "url", "record_type", "refers_to", "payload_digest", *[F.col(f"__of_{c}").alias(c) for c in columns])
    return narrow.where("record_type <> 'revisit'").unionByName(full)
