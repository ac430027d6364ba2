"""WARC archives: write captures as transactions, read them back and put them together.

A capture is written as three records: its response (or a revisit of an earlier response
with the same payload), the request and a metadata record, the last two naming the first
as concurrent.  Reading gives one row a record; :func:`assemble` joins the records of a
transaction through those identifiers into one nested row.

Archives are written by Spark's text writer as gzip files, so any store that Spark
reaches will do, and the pieces of one file come back in order: a piece that its
predecessor's Content-Length still claims belongs to that record's block, even if it
starts like a record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, durable

#: Payloads below this many bytes are always written whole.
REVISIT_BYTES = 100
#: Most captures of a file, and about how many bytes before compression.
CAPTURES_PER_FILE, FILE_BYTES = 20_000, 1 << 30
_CRLF = "\r\n"
_MARK = "WARC/1.1\r\n"
_ANY_MARK = "WARC/1."  # 1.0 is read as well
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "content_type string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def _urn(*parts: Column) -> Column:
    """A UUID made from the parts, as an URN in angle brackets."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends within a value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_CRLF)), F.lit(""))


def _record(block: Column, *lines: Column) -> Column:
    return F.concat(F.lit(_MARK), *lines, _line("Content-Length", F.octet_length(block).cast("string")), F.lit(_CRLF), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES, each: bool = False) -> None:
    """Write a transaction per row of ``pages`` into archives below ``path``.

    Of rows with equal payloads of ``revisit_bytes`` or more, that with the smallest id is
    the response and the others revisit it; a null id is no smallest id.  A null body is an
    empty payload.  Rows equal in id, address and payload are one capture, or with ``each``
    captures of their own.
    """
    body = F.coalesce(pages[body_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("size", F.octet_length("body"))
    first = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first"), F.count("*").alias("n"))
    # written first, so that Spark may split the join at a payload of very many rows
    first = durable(first.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    size = pages.agg(F.avg(F.octet_length(body))).first()[0] or 0
    per_file = int(min(CAPTURES_PER_FILE, max(1, FILE_BYTES // (size + 1000))))
    rows = rows.join(first, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")))
    if each:
        same = Window.partitionBy("id", "url", "digest").orderBy(F.lit(1))
        rows = rows.withColumn("nth", F.row_number().over(same))
    nth = (F.col("nth"),) if each else ()
    key = (F.col("id"), F.col("url"), F.col("digest"), *nth)
    capture = _urn(F.lit("response"), *key)
    common = (_line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    response = _record(
        F.when(F.col("again"), head).otherwise(F.concat(head, F.col("body"))),
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), _line("WARC-Record-ID", capture), *common,
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(_line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _urn(F.lit("response"), F.col("first.id"), F.col("first.url"), F.col("digest"), *(F.lit(1) for _ in nth))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    host, target = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#\s]*)", 1), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#\s]*([^#\s]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_CRLF * 2))
    request = _record(F.coalesce(asked, F.lit("")), _line("WARC-Type", F.lit("request")), _line("WARC-Record-ID", _urn(F.lit("request"), *key)), *common, _line("WARC-Concurrent-To", capture), _line("Content-Type", F.lit("application/http; msgtype=request")))
    notes = F.concat(_line("page-id", F.col("id").cast("string")), _line("payload-bytes", F.col("size").cast("string")))
    metadata = _record(notes, _line("WARC-Type", F.lit("metadata")), _line("WARC-Record-ID", _urn(F.lit("metadata"), *key)), *common, _line("WARC-Concurrent-To", capture), _line("Content-Type", F.lit("application/warc-fields")))
    end = F.lit(_CRLF * 2)
    rows.select(F.concat(response, end, request, end, metadata).alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    return out


def parse_record(head: bytes, block: bytes, keep_payload: bool) -> dict:
    """One record: its header fields and what its block holds."""
    fields = _headers(head)
    kind, form = fields.get("warc-type"), fields.get("content-type", "")
    payload, inner = block, {}
    if form.startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        inner = _headers(top.partition(b"\r\n")[2])
    elif form.startswith("application/warc-fields"):
        inner = _headers(block)
    whole = kind != "revisit"
    given = inner.get("content-length", "")
    return {
        "warc_type": kind, "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"), "content_type": form or None,
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else fields.get("warc-payload-digest", "").rpartition(":")[2].lower() or None,
        "payload_bytes": len(payload) if whole else int(given) if given.isdigit() else None,
        "fields": list(inner.items()), "payload": payload if keep_payload and whole else None,
    }


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives below ``path`` (columns: ``RECORD``).

    Digest and size are those of the payload as read; a revisit gives what its headers
    declare of the full payload.  A record that its file cuts short is left out.  Fields
    may be missing and are null then; of a repeated field the first counts; an empty folder
    gives no record.  A file that is not compressed as a whole is refused, for Spark would
    split it within a record.
    """
    bound_batches(spark)
    pieces = spark.read.option("lineSep", _ANY_MARK).text(path)
    plain = [f for f in pieces.inputFiles() if not f.endswith(".gz")]
    if plain:
        raise ValueError(f"not a gzip archive: {plain[0]}")
    mark = _ANY_MARK.encode()
    types = pa.schema([
        *((n, pa.string()) for n in ("warc_type", "record_id", "concurrent_to", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest")),
        ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, size, wanted = None, [], 0, None

        def length(piece: bytes) -> int | None:
            """Bytes that a record has after its mark, up to the end of its block."""
            end = piece.find(b"\r\n\r\n")
            given = _headers(piece[:end]).get("content-length", "") if end >= 0 and piece[:3] in (b"0\r\n", b"1\r\n") else ""
            return end + 4 + int(given) if given.isdigit() else None

        for batch in batches:
            rows = []
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    name, parts, size, wanted = file, [], 0, None
                if wanted is None:
                    parts, size, wanted = [piece], len(piece), length(piece)
                else:
                    parts += [mark, piece]
                    size += len(mark) + len(piece)
                if wanted is not None and size >= wanted:
                    head, _, block = b"".join(parts)[:wanted].partition(b"\r\n\r\n")
                    rows.append(parse_record(head, block, keep_payload))
                    wanted = None
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata, n_requests, n_metadata, refers_to).

    ``response`` is the capture's response or revisit record; ``request`` and ``metadata``
    are those that name it as concurrent (of several, the first by identifier; counts tell
    how many).  Records repeated under one identifier are one.  ``refers_to`` is the capture
    that a revisit points to.  Requests and metadata without a capture give no row.
    """
    side = F.col("warc_type").isin("request", "metadata")
    key = F.when(side, F.coalesce("concurrent_to", "record_id")).otherwise(F.col("record_id"))
    row = F.struct("record_id", "warc_type", "target_uri", "warc_date", "content_type", "payload_digest", "payload_bytes", "refers_to", "payload")
    note = F.struct("record_id", "content_type", "payload", F.to_json("fields").alias("fields"))
    of = lambda kind: F.when(F.col("warc_type") == kind, note)
    out = records.where(F.col("warc_type").isin("request", "metadata", "response", "revisit")).groupBy(key.alias("capture_id")).agg(
        F.min(F.when(~side, row)).alias("response"), F.min(of("request")).alias("request"), F.min(of("metadata")).alias("metadata"),
        F.count_if(F.col("warc_type") == "request").alias("n_requests"), F.count_if(F.col("warc_type") == "metadata").alias("n_metadata"),
    )
    return out.where(F.col("response").isNotNull()).withColumn("refers_to", F.col("response.refers_to"))
