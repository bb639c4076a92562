"""WARC archives: writing with deduplication, reading back with segment reassembly.

Writing. A page becomes a ``response`` record (an HTTP message whose body has chunked transfer framing), or a ``revisit``
record if an equal payload of at least ``least_bytes`` bytes has a smaller page id. A record block of more than
``segment_bytes`` is cut into segments: the first keeps the type, the others are ``continuation`` records that name the
origin record and their number; the last also gives the total length. Spark's text writer puts the records into gzip
archives of a bounded number of records, in a folder all executors share.

Reading. An archive is bounded, so one row holds one; records are cut by Content-Length, never by searching for marks.
Whole records are decoded where they are read. Segments are grouped by origin, ordered by number, checked (numbers
without gaps, total length) and joined; a payload is one page, which is the only thing a group holds. Chunked framing
is decoded at the end. A record that fails a check gives a null payload.

Defined results: null html is an empty payload; null url gives no target header; control characters of a url are
percent-encoded; rows that repeat a page id and payload are each written as the response; a null page id counts as the
smallest; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import batch_of, shared_folder

END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK = 4096
SEGMENT_BYTES = 16384
RECORDS_PER_ARCHIVE = 1000

FIELDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("page", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(message: bytes) -> bytes | None:
    """Body of an HTTP message; None if its framing is broken."""
    head, found, rest = message.partition(b"\r\n\r\n")
    if not found:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return rest
    at, out = 0, []
    while True:
        stop = rest.find(END, at)
        try:
            size = int(rest[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        out.append(rest[stop + 2 : stop + 2 + size])
        at = stop + 2 + size
        if rest[at : at + 2] != END:
            return None
        at += 2


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """Without the two line ends that follow a record."""
    head = b"".join(b"%b: %b\r\n" % f for f in fields)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b" % (head, len(block), block)


def _escaped(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())


def page_records(name: str, page, url, body: bytes | None, digest: str, refers, date: str, segment_bytes: int):
    """The record of a page, in segments if it is long; no body: a revisit."""
    base = [(b"WARC-Date", date.encode())]
    origin = b"<urn:uuid:%b>" % name.encode()
    first = [(b"WARC-Record-ID", origin), *base]
    if page is not None:
        first.append((b"X-Page-ID", str(page).encode()))
    if url is not None:
        first.append((b"WARC-Target-URI", _escaped(url)))
    first.append((b"WARC-Payload-Digest", b"sha256:" + digest.encode()))
    if body is None:
        if refers is not None:
            first.append((b"WARC-Refers-To", b"<urn:page:%b>" % str(refers).encode()))
        first.append((b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        yield record([(b"WARC-Type", b"revisit"), *first], b"")
        return
    block = HTTP + chunked(body)
    first = [(b"WARC-Type", b"response"), *first, (b"Content-Type", b"application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield record(first, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        number = [(b"WARC-Segment-Number", b"%d" % k)]
        if k == len(cuts):
            number.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        if k == 1:
            yield record(first + number, block[at : at + segment_bytes])
        else:
            own = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", origin[:-1] + b":%d>" % k), *base]
            yield record([*own, (b"WARC-Segment-Origin-ID", origin), *number], block[at : at + segment_bytes])


def records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 100,
    segment_bytes: int = SEGMENT_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """(record): bytes of every record, without the line ends behind it."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest")
    )
    # min() skips nulls, so a null id is told by a flag; copies are counted before the shuffle
    repeated = (
        rows.where(F.length("body") >= least_bytes)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min(F.struct(F.col("page").isNotNull().alias("known"), "page")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    joined = rows.join(repeated, F.col("digest") == F.col("_digest"), "left").select(
        F.expr("uuid()").alias("name"),
        "page",
        "url",
        F.when(F.col("first").isNull() | F.col("first.page").eqNullSafe(F.col("page")), F.col("body")).alias("body"),
        "digest",
        F.col("first.page").alias("refers"),
    )
    schema = T.StructType([T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                r
                for name, page, url, body_, digest, refers in zip(*[c.to_pylist() for c in b.columns])
                for r in page_records(name, page, url, body_, digest, refers, date, segment_bytes)
            ]
            yield batch_of(schema, [out])

    return joined.mapInArrow(run, schema)


def write(rows: DataFrame, folder: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Gzip archives under ``folder``. The writer's line end is the end of a record."""
    (
        rows.select(F.col("record").cast("string"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_archive)
        .text(folder)
    )


def parse(archive: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields by lower-case name, block) of each record."""
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        lines = archive[at:stop].split(END)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(fields[b"content-length"])
        yield fields, archive[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def _text(x: bytes | None) -> str | None:
    return None if x is None else x.decode()


def segments(spark: SparkSession, folder: str, whole: bool) -> DataFrame:
    """Rows of records that are whole (with the decoded payload as block), or of those in segments (with their part)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parse(zlib.decompress(content.as_buffer(), 31)):
                    number = f.get(b"warc-segment-number")
                    if (number is None) != whole:
                        continue
                    kind = f[b"warc-type"].decode()
                    total = f.get(b"warc-segment-total-length")
                    refers = f.get(b"warc-refers-to")
                    rows.append(
                        (
                            f[b"warc-record-id"].decode(),
                            _text(f.get(b"warc-segment-origin-id", f[b"warc-record-id"])),
                            int(number or 0),
                            None if total is None else int(total),
                            _text(f.get(b"x-page-id")),
                            kind,
                            None if refers is None else refers[len(b"<urn:page:") : -1].decode(),
                            None if kind == "continuation" else f[b"warc-payload-digest"].decode().removeprefix("sha256:"),
                            None if kind == "revisit" else unchunked(block) if whole else block,
                        )
                    )
                    if len(rows) == 500:
                        yield batch_of(FIELDS, zip(*rows))
                        rows = []
                if rows:
                    yield batch_of(FIELDS, zip(*rows))

    return files.mapInArrow(run, FIELDS)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per origin record with its decoded payload (null if segments are missing or the length is wrong)."""
    first = F.expr("filter(parts, p -> p.segment = 1)[0]")
    grouped = (
        parts.groupBy("origin")
        .agg(
            F.sort_array(F.collect_list(F.struct("segment", "block", "page", "record_type", "refers_to", "digest"))).alias("parts"),
            F.max("total").alias("total"),
        )
        .select(
            F.col("origin").alias("record_id"),
            *[first[n].alias(n) for n in ("page", "record_type", "refers_to", "digest")],
            F.expr(
                "transform(parts, p -> p.segment) = sequence(1, size(parts))"
                " AND aggregate(parts, 0L, (n, p) -> n + length(p.block)) = total"
            ).alias("sound"),
            F.col("parts.block").alias("blocks"),
        )
    )
    schema = T.StructType([*[f for f in FIELDS if f.name in ("record_id", "page", "record_type", "refers_to", "digest")], FIELDS["block"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [
                unchunked(b"".join(x)) if ok else None for ok, x in zip(b.column(5).to_pylist(), b.column(6).to_pylist())
            ]
            yield batch_of(schema, [*b.columns[:5], bodies])

    return grouped.mapInArrow(run, schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, page, record_type, refers_to, digest, block): every record with its payload, null for revisits."""
    names = ["record_id", "page", "record_type", "refers_to", "digest", "block"]
    return segments(spark, folder, whole=True).select(names).unionByName(reassemble(segments(spark, folder, whole=False)).select(names))


def round_trip(pages: DataFrame, id_col: str = "page_id", folder: str | None = None, **names) -> DataFrame:
    """Write all pages, read the archives back, and describe every page by what was read."""
    from scenetally.session import pin

    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write(records(pages, id_col, **names), folder)
    kind = pages.schema[id_col].dataType
    back = pin(
        read(spark, folder).select(
            F.col("page").cast(kind).alias(id_col),
            "record_type",
            F.col("refers_to").cast(kind).alias("refers_to"),
            F.length("block").cast("long").alias("_bytes"),
            F.sha2("block", 256).alias("_digest"),
            "digest",
        )
    )
    response = back.where("record_type = 'response'").select(
        F.col(id_col).alias("_id"), F.col("_bytes").alias("_of"), F.col("_digest").alias("_seen")
    ).distinct()
    revisit = back.where("record_type = 'revisit'").join(
        response, F.col("refers_to").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_seen")), "left"
    )
    columns = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        back.where("record_type = 'response'")
        .withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")})
        .select(columns)
        .unionByName(revisit.withColumns({"payload_bytes": F.col("_of"), "payload_digest": F.col("digest")}).select(columns))
    )
