"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an earlier, equal payload) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Archives are written and read through Spark's own file sources,
so any store that Spark reaches will do. The reader streams: Spark splits an archive at the version lines, and a task
joins the pieces to records by their Content-Length, so that it holds one record and never a whole archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.work import materialize, small_batches

CRLF = "\r\n"
BASE32, BASE32HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Captures in one file: a gzip file is one task of the reader.
CAPTURES_PER_FILE = 2000
#: Start of every record; the reader splits archives here.
VERSION = b"WARC/1."

RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, verified boolean, fields map<string,string>"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits in eight groups of 20 bits, each four base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.upper(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), BASE32HEX, BASE32)


def _uuid(run: str, kind: str, name: Column) -> Column:
    """A name-based urn:uuid (version 8) for a record of one run of the writer."""
    h = F.md5(F.concat(F.lit(f"{run}:{kind}:"), name.cast("string")))
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _record(headers: list[Column], block: Column) -> Column:
    """One record; the two line ends after the block included."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *headers, length), F.lit(CRLF * 2), block, F.lit(CRLF * 2))


def _header(name: str, value: Column) -> Column:
    """Null, and so left out, if the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def write_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a capture for every row into gzip archives under path.

    Of payloads that are equal and have at least min_bytes bytes, the row with the smallest id (null last) is a
    response and the others are revisits of it. Record ids are names within this call (a random run and the capture's
    number), so archives of several calls can be read together. A null html is an empty payload; a null url leaves out
    WARC-Target-URI; white space and control characters of a url are percent-encoded. A payload may be of any length.
    Repeated rows are captures of their own. An empty table writes no records; other columns are ignored.
    """
    run = uuid.uuid4().hex
    url = F.col(f"`{url_col}`").cast("string")
    for code in (*range(0x20), 0x20, 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("capture"))
    hashed = materialize(source.withColumns({"digest": sha1_base32(F.encode("html", "UTF-8")), "bytes": F.octet_length("html").cast("long")}), "warc-pages")
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "capture")
    firsts = hashed.groupBy("digest").agg(F.min(place).alias("first"))
    joined = hashed.join(materialize(firsts.select("digest", F.col("first.capture").alias("first")), "warc-firsts"), "digest")

    once = F.col("bytes") >= min_bytes
    again = once & (F.col("capture") != F.col("first"))
    own = F.when(again | ~once, _uuid(run, "capture", F.col("capture"))).otherwise(_uuid(run, "payload", F.col("digest")))
    uri, when = _header("WARC-Target-URI", F.col("url")), F.lit(f"WARC-Date: {date}")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    common = [when, uri, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))]
    to_response = _header("WARC-Concurrent-To", F.col("own"))
    response = _record([F.lit("WARC-Type: response"), _header("WARC-Record-ID", F.col("own")), *common, F.lit("Content-Type: application/http; msgtype=response")], F.concat(http, F.col("html")))
    revisit = _record(
        [F.lit("WARC-Type: revisit"), _header("WARC-Record-ID", F.col("own")), *common, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), _header("WARC-Refers-To", _uuid(run, "payload", F.col("digest"))), F.lit("Content-Type: application/http; msgtype=response")],
        http,
    )
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    request = _record([F.lit("WARC-Type: request"), _header("WARC-Record-ID", _uuid(run, "request", F.col("capture"))), when, uri, to_response, F.lit("Content-Type: application/http; msgtype=request")], asked)
    noted = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record([F.lit("WARC-Type: metadata"), _header("WARC-Record-ID", _uuid(run, "metadata", F.col("capture"))), when, uri, to_response, F.lit("Content-Type: application/warc-fields")], noted)
    answered = F.when(again, revisit).otherwise(response)
    value = F.concat(request, answered, metadata)
    # the writer ends each row with lineSep: leave out the last line end
    rows = joined.withColumn("own", own).withColumn("value", value).select(F.substring("value", F.lit(1), F.length("value") - 2).alias("value"))
    rows.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n") if b":" in line)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in pairs}


def records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, from (archive, bytes between two VERSIONs) in order.

    A VERSION within a record only cuts it into pieces: they are joined until the record has its Content-Length.
    """
    archive, record, want, headers = None, None, None, {}

    def finished() -> bytes:
        if want is None or len(record) < want:
            raise ValueError(f"{archive} ends within a record")
        if bytes(record[want:]).strip():
            raise ValueError(f"{archive}: bytes after a record's end")
        return bytes(record[want - int(headers["content-length"]) : want])

    for name, piece in pieces:
        if name != archive:
            if record is not None:
                yield headers, finished()
            if piece.strip():
                raise ValueError(f"{name} does not start with a WARC record")
            archive, record, want = name, None, None
            continue
        if record is not None and want is not None and len(record) >= want:
            yield headers, finished()
            record, want = None, None
        if record is None:
            record = bytearray(piece)
        else:
            record += VERSION + piece
        if want is None and (end := record.find(b"\r\n\r\n")) >= 0:
            headers = _fields(bytes(record[:end]).partition(b"\r\n")[2])
            want = end + 4 + int(headers["content-length"])
    if record is not None:
        yield headers, finished()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("verified", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string()))])
    rows: list[dict] = []
    pieces = ((name, piece) for batch in batches for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for headers, block in records(pieces):
        kind, said = headers["warc-type"], headers.get("warc-payload-digest")
        row = {"record_id": headers["warc-record-id"], "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "payload_digest": said and said.removeprefix("sha1:")}
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            row["fields"] = list(_fields(http.partition(b"\r\n")[2]).items())
            if kind == "response":
                row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                row["verified"] = said in (None, "sha1:" + row["payload_digest"])
                row["payload_bytes"] = len(payload)
            else:
                row["payload_bytes"] = int(dict(row["fields"]).get("content-length", 0))
        elif kind == "metadata":
            row["fields"] = list(_fields(block).items())
        rows.append(row)
        if len(rows) >= 5000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives under path, in the columns of RECORD.

    Digests and lengths of responses are taken from the payload itself; verified tells whether the digest in the
    header is the same. Those of revisits are the header's. Archives may have one gzip member or one for each record,
    and any length: a task streams through them. Columns that a record has no value for are null. A broken archive
    raises; a folder without archives gives no rows.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", VERSION.decode()).option("pathGlobFilter", "*.gz").text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_parse, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: response_id, response, request, metadata (nested records, null where absent).

    Request and metadata join the response they name in WARC-Concurrent-To; a response stands for itself. A record
    that names a response that isn't there gives a capture without a response. If several records of one kind name one
    response, the one with the smallest record id stays; repeated rows are one record. An empty table gives no rows.
    """
    record = F.struct(*[c for c in found.columns])
    slim = found.select(F.coalesce("concurrent_to", "record_id").alias("response_id"), "type", "record_id", record.alias("record"))
    of = lambda *kinds: F.min_by(F.when(F.col("type").isin(*kinds), F.col("record")), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    return slim.groupBy("response_id").agg(of("response", "revisit").alias("response"), of("request").alias("request"), of("metadata").alias("metadata"))


def captured_pages(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page id of a revisit's response).

    Captures without a response are left out. page_id is null without a metadata record that tells it; refers_to is
    null for responses, and for revisits of a response that isn't among the captures. An empty table gives no rows.
    """
    flat = materialize(
        captures.where("response is not null").select(
            "response_id",
            F.expr("try_cast(metadata.fields['page-id'] as bigint)").alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("target"),
        ),
        "warc-captures",
    )
    plain = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    own = flat.where("record_type = 'response'")
    targets = own.select(F.col("response_id").alias("target"), F.col("page_id").alias("refers_to"))
    again = flat.where("record_type <> 'response'").join(targets, "target", "left").select(*plain, "refers_to")
    return own.select(*plain, F.lit(None).cast("long").alias("refers_to")).unionByName(again)
