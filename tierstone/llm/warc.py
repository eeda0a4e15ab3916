"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is a response (or, where its payload is another's, a revisit), the request that led to it and a metadata record;
the latter two name the first by WARC-Concurrent-To. Assembly joins the three by these identifiers, in whatever files
and order they stand, into one nested row a capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm.common import Scratch, let, own_columns, table

#: Records a file at most, payloads of fewer bytes that are never revisits, and repeated payloads that may be broadcast.
RECORDS_A_FILE, LEAST_REVISITED, MOST_BROADCAST = 30_000, 0, 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, 32 letters without padding: 5 hex digits are 20 bits are 4 letters."""
    def spelled(h: Column) -> Column:
        five = [F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(x, s).bitwiseAND(31) + 1, F.lit(1)) for x in five for s in (15, 10, 5, 0)])

    return let(F.sha1(payload), spelled)


def _uuid(*parts: Column) -> Column:
    """A record's identifier, the same in every run."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"), F.substring(h, at, n)) if at > 1 else (F.substring(h, at, n),))], F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value, r"[\r\n]+", " "))) for name, value in fields]
    return F.concat(F.lit("WARC/1.1"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISITED) -> None:
    """Three records for each row of pages, as gzipped WARC files under path.

    A null html is an empty payload. Of the rows with one payload of at least `least` bytes, that with the largest id is a
    response and the others are revisits of it; rows that repeat it whole, id included, are responses too. Payloads are
    told apart by SHA-1 and size. A null url has no target field; a null id sorts below all others. An empty table gives none.
    """
    rows = own_columns(pages, {"id": id_col, "url": url_col, "html": html_col}).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("id", F.col("id").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    heads = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "head")
    heads = Scratch(pages.sparkSession, "payloads").save(heads, "heads")
    few = heads.count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(heads) if few else heads, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.coalesce(F.coalesce("id", F.lit(-(2**63) + 1)) < F.col("head"), F.lit(False))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    own, headed = _uuid(F.lit("response"), key, F.col("digest")), _uuid(F.lit("response"), F.col("head").cast("string"), F.col("digest"))
    when = F.lit(date)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    common = lambda kind, rid: [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", when), ("WARC-Target-URI", F.col("url"))]
    response = _record(
        [
            *common(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), own),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(revisit, headed)),
            ("X-Refers-To-Page", F.when(revisit, F.col("head").cast("string"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
    )
    host, target = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")), F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    request = _record(
        [*common(F.lit("request"), _uuid(F.lit("request"), key, F.col("digest"))), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    metadata = _record(
        [*common(F.lit("metadata"), _uuid(F.lit("metadata"), key, F.col("digest"))), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    # a record ends with two line ends: the line separator of the text writer
    joined.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


class BadRecord(ValueError):
    """A record that does not follow the format, or whose payload is not what its digest says."""


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, by lower-cased name, and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise BadRecord(line[:80])
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise BadRecord(f"{fields.get('warc-record-id')} is cut off")
        yield fields, block


_RECORD = "record_id string, record_type string, concurrent_to string, uri string, date string, refers_to string, refers_to_page long, payload_digest string, payload_bytes long, payload binary"


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = fields.get("warc-type", "")
    digest, size, payload = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, block
    if kind in ("response", "revisit") and "application/http" in fields.get("content-type", ""):
        head, _, payload = block.partition(b"\r\n\r\n")
        told = [x.partition(b":")[2].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        size = int(told[-1]) if kind == "revisit" and told else len(payload)
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, found):
                raise BadRecord(f"{fields.get('warc-record-id')}: the payload's digest is {found}")
            digest = found
    page = fields.get("x-refers-to-page")
    return (fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"), int(page) if page else None, digest, size, payload if payloads or kind == "metadata" else None)


def _parsing(payloads: bool):
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                rows, held = [], 0
                for fields, block in parse_records(stream):
                    rows.append(_row(fields, block, payloads))
                    held += len(block) if payloads else 200
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return parse


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the WARC files under path, gzipped or not; without payloads but those of metadata if not asked for."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsing(payloads), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """capture_id, uri, responses, requests, metadata (arrays of records) for each capture.

    Requests and metadata belong to the record that WARC-Concurrent-To names, in any file or order; without the field, or where
    the named record is missing, they make a capture that has no response. A record that repeats whole is kept as often
    as it stands. Other record types are left out.
    """
    leading = F.col("record_type").isin("response", "revisit")
    kept = records.where(leading | F.col("record_type").isin("request", "metadata"))
    one = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    of = lambda what: F.collect_list(F.when(what, one))
    return kept.groupBy(F.when(leading, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture_id")).agg(
        F.max("uri").alias("uri"), of(leading).alias("responses"), of(F.col("record_type") == "request").alias("requests"), of(F.col("record_type") == "metadata").alias("metadata")
    )


def op1_transaction_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    write_captures(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_records(spark, path, payloads=False))
    rows = captures.select(F.expr("nullif(regexp_extract(cast(get(metadata, 0).payload as string), '^page: (-?[0-9]+)', 1), '')").cast("long").alias("page_id"), F.size("requests").alias("n_requests"), F.explode("responses").alias("r"))
    return rows.select("page_id", "r.payload_bytes", "r.payload_digest", "r.record_type", F.col("r.refers_to_page").alias("refers_to"), F.col("r.uri").alias("uri"), "n_requests")


OP1_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}',
  ((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS head FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to, url AS uri, 1::INTEGER AS n_requests FROM m
"""
