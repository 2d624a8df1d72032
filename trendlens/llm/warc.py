"""WARC archives: write records, read them back, and assemble transactions.

Each capture is three records: the request, the response (or a revisit of an equal payload), and a metadata record;
request and metadata name the response's record id as concurrent-to. Archives are written by Spark's text writer with
the record separator as line separator, so they go wherever Spark can write; they are read by Spark's text reader, which
streams, in pieces between record starts, and cut by Content-Length. A task holds one record and one batch of pieces at a
time, however long an archive is; its records are one string each, so at most 2 GB. Transaction assembly joins the records through their concurrent-to ids to one nested row per
capture.

Of equal payloads of at least ``min_revisit`` bytes the one with the largest page_id is the response, the others revisit
it. Defined cases: null html is the empty payload, a null url leaves the target out; repeated rows are captures of their
own, and of rows that tie for the largest page_id the last in the table is the response; rows with null page_id have no
order, so each is a response and is revisited by none; an empty table gives an archive without records and no rows;
blanks and control characters in a url are percent-encoded; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlens.session import scratch_dir, settle

CRLF = "\r\n"
START = b"\nWARC/"  # begins with its only line end, so it cannot overlap itself
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("record_type string, record_id string, concurrent_to string, refers_to string, target string, page_id long, "
           "payload_digest string, payload_bytes long, payload binary")


def _record_id(kind: str, key: Column) -> Column:
    """A record id made from the capture's row key: the same when a task runs again."""
    h = F.md5(F.concat(F.lit(kind + ":"), key).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_types(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """(page_id, url, html) to captures: payload, digest, record type, and the page_id that a revisit refers to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"), F.monotonically_increasing_id().alias("row"))
    key = F.struct("page_id", "row")
    # Only payloads that occur more than once, and only as digest and page: a small part of the table, read back from
    # files so that its size is known before it is joined.
    groups = settle(rows.where((F.col("payload_bytes") >= min_revisit) & F.col("page_id").isNotNull())
                    .groupBy("payload_digest", "payload_bytes")
                    .agg(F.max(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    joined = rows.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce((F.col("first.row") != F.col("row")) & F.col("page_id").isNotNull(), F.lit(False))
    return joined.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("first.page_id")), "refers_row": F.when(revisit, F.col("first.row"))}).drop("first")


def records(captures: DataFrame) -> DataFrame:
    """One text column ``record`` per capture: its response (or revisit), request and metadata records."""
    key = F.col("row").cast("string")
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF))).otherwise("")
    main = _record_id("response", key)
    date = F.lit("WARC-Date: 2024-01-01T00:00:00Z" + CRLF)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    is_revisit = F.col("record_type") == "revisit"

    def record(kind: Column, rid: Column, more: Column, block: Column, media: str) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), rid, F.lit(CRLF), date, target, more,
            F.lit(f"Content-Type: {media}{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
            F.lit(CRLF * 2), block)

    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF))
    refers = F.when(is_revisit, F.concat(
        F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "),
        _record_id("response", F.col("refers_row").cast("string")), F.lit(CRLF))).otherwise("")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), main, F.lit(CRLF))
    response = record(F.col("record_type"), main, F.concat(digest, refers),
                      F.concat(http, F.when(is_revisit, "").otherwise(F.col("payload"))), "application/http;msgtype=response")
    request = record(F.lit("request"), _record_id("request", key), concurrent,
                     F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")),
                     "application/http;msgtype=request")
    metadata = record(F.lit("metadata"), _record_id("metadata", key), concurrent,
                      F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
                      "application/warc-fields")
    return captures.select(F.concat_ws(CRLF * 2, response, request, metadata).alias("record"))


def write_warc(captures: DataFrame, folder: str, per_file: int = 0) -> None:
    """Write archives. Each record is followed by two line ends, as the format wants.

    A file holds what one task has, so its bytes follow the session's split and shuffle partition sizes, whatever the
    size of a page; at most ``per_file`` captures if that is given.
    """
    (records(captures).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(folder))


def _fields(lines: bytes) -> dict[str, str]:
    """Header lines by name in lower case; of a repeated name the first. A line that begins with a blank goes on."""
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split(CRLF):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _record(head: dict[str, str], block: bytes) -> dict:
    """A row of ``RECORDS``. Raises if a payload and its SHA-1 differ."""
    kind = head.get("warc-type", "").lower()
    row = {"record_type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
           "refers_to": head.get("warc-refers-to"), "target": head.get("warc-target-uri")}
    if kind in ("response", "revisit"):
        top, end, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        name, _, said = head.get("warc-payload-digest", "").partition(":")
        if name.lower() == "sha1" and len(said) == 32:
            said = base64.b32decode(said.upper()).hex()
        if kind == "response":
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
            if name.lower() == "sha1" and said.lower() != row["payload_digest"]:
                raise ValueError(f"payload and digest differ in {row['record_id']}")
        else:
            length = _fields(top).get("content-length", "")
            row |= {"payload_bytes": int(length) if length.isdigit() else None,
                    "payload_digest": said.lower() if name.lower() == "sha1" else None}
    elif kind == "metadata":
        value = _fields(block).get("page_id", "")
        row["page_id"] = int(value) if value.removeprefix("-").isdigit() else None
    return row


def _cut(pieces):
    """(header fields, block) of each record, from (archive, piece) in order; pieces were parted by START.

    A block may hold START itself: then pieces are added until the record has the length it states.
    """
    name, held, size, need = None, [], 0, 0
    for archive, piece in itertools.chain(pieces, [(None, b"")]):
        if archive != name:
            if b"".join(held).strip():
                raise ValueError(f"{name} ends within a record")
            name, held, size, need = archive, [piece], len(piece), 0
        else:
            held += [START, piece]
            size += len(START) + len(piece)
        while size >= need:
            data = b"".join(held).lstrip(b"\r\n")
            stop = data.find(b"\r\n\r\n")
            held, size, need = [data], len(data), 0
            if stop < 0:
                break
            head = _fields(data[:stop])
            need = stop + 4 + int(head["content-length"])
            if size >= need:
                yield head, data[stop + 4: need]
                held, size, need = [data[need:]], size - need, 0


def read_warc(spark, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives (``*.gz``) in a folder, other programs' as well; ``payloads=False`` leaves ``payload`` null.

    Header names may be in any case, digests in hex or base 32. ``page_id`` is a field of metadata records (null if
    there is none or no number); a response without an HTTP header is all payload; payloads with a SHA-1 are checked
    against it. An archive that ends within a record is an error.
    """
    def cut(batches):
        import pyarrow as pa

        pieces = ((archive, piece) for batch in batches for archive, piece in zip(
            batch.column(0).to_pylist(), (v.as_py() for v in batch.column(1))))
        out, held = [], 0
        for head, block in _cut(pieces):
            out.append(_record(head, block) if payloads else _record(head, block) | {"payload": None})
            held += len(block) + 1_000
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))
    pieces = spark.read.option("lineSep", START.decode()).option("pathGlobFilter", "*.gz").text(folder)
    return pieces.select("_metadata.file_path", F.col("value").cast("binary")).mapInArrow(cut, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """Transactions: one nested row per capture, request and metadata joined through concurrent-to ids."""
    nested = F.struct(*[c for c in found.columns if c != "concurrent_to"])
    main = found.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), nested.alias("response"))

    def side(kind: str) -> DataFrame:
        return found.where(F.col("record_type") == kind).select(F.col("concurrent_to").alias("capture_id"), nested.alias(kind))

    return main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read them back and give one row per page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url", "html")
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(with_types(pages), folder)
    captures = assemble(settle(read_warc(spark, folder, payloads=False).drop("payload", "target")))
    rows = settle(captures.select(
        F.col("metadata.page_id").alias("page_id"), "response.record_id", "response.payload_bytes",
        "response.payload_digest", "response.record_type", F.col("response.refers_to").alias("refers_id")))
    wanted = rows.where("refers_id is not null").select(F.col("refers_id").alias("record_id")).distinct()
    named = settle(rows.join(wanted, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")))
    return rows.join(named, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS first_page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
  CASE WHEN first_page > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_page > page_id THEN first_page END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
