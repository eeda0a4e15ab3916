"""Every query of the library outside the llm subpackage, with its SQL where SQL has it. Numbers follow the survey's list."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.config import MIB, Tiers
from tierstone.functions import http, identity, placement, protocol
from tierstone.operators import catalog, eviction, machine, metrics, replay
from tierstone.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BIG_TIERS, STRIPE, DRIVES = Tiers(), MIB, 5
NOW = V.NOW


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from tierstone.plans import store  # noqa: F401  # it adds its queries to these

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


# identity and placement


@query(f"WITH {V.OBJ} SELECT key, digest FROM obj")
def q01_digest(spark, d):
    return V.objects(spark, d).select("key", "digest")


@query(f"WITH {V.BIG} SELECT key, bucket::VARCHAR AS bucket FROM big")
def q02_bucket(spark, d):
    return V.large(spark, d).select("key", F.col("bucket").cast("string").alias("bucket"))


@query(f"WITH {V.BIG} SELECT ('0x' || substr(digest, 1, 2))::INTEGER AS shard, count(*) AS n FROM big GROUP BY 1")
def q03_shard_histogram(spark, d):
    return V.large(spark, d).groupBy(identity.shard(F.col("digest")).alias("shard")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.OBJ} SELECT key, '"' || lower(to_base(size, 16)) || '-' || lower(to_base(etag, 16)) || '"' AS tag FROM obj""")
def q04_etag(spark, d):
    return V.objects(spark, d).select("key", identity.etag(F.col("size"), F.col("etag")).alias("tag"))


_LAYOUT = """least(size, {ram}) AS head, CASE WHEN size <= {ram} THEN 0 ELSE least(size, {ssd}) END AS ssd, CASE WHEN size <= {ram} THEN 0 ELSE greatest(size - {ssd}, 0) END AS hdd"""
_BIG_LAYOUT = _LAYOUT.format(ram=BIG_TIERS.ram_head, ssd=BIG_TIERS.ssd_prefix)


@query(
    f"WITH {V.BIG}, l AS (SELECT size, {_BIG_LAYOUT} FROM big) SELECT CASE WHEN hdd > 0 THEN 'hdd' WHEN ssd > 0 THEN 'ssd' ELSE 'ram' END AS deepest, count(*) AS objects, sum(size)::BIGINT AS total,"
    " sum(head)::BIGINT AS head, sum(ssd)::BIGINT AS ssd, sum(hdd)::BIGINT AS hdd FROM l GROUP BY 1"
)
def q05_layout_totals(spark, d):
    rows = V.large(spark, d).select("size", placement.layout(F.col("size"), BIG_TIERS, True).alias("l")).select("size", "l.*")
    deepest = F.when(F.col("hdd") > 0, "hdd").when(F.col("ssd") > 0, "ssd").otherwise("ram")
    return rows.groupBy(deepest.alias("deepest")).agg(F.count("*").alias("objects"), F.sum("size").alias("total"), *[F.sum(c).alias(c) for c in ("head", "ssd", "hdd")])


@query(f"WITH {V.OBJ}, l AS (SELECT *, {_LAYOUT.format(ram=4096, ssd=16384)} FROM obj) SELECT key, head, ssd, hdd FROM l")
def q05b_layout_small(spark, d):
    return V.objects(spark, d).select("key", placement.layout(F.col("size"), V.SMALL, True).alias("l")).select("key", "l.*")


@query(f'''WITH {V.BIG}, l AS (SELECT key, size // 2 AS off, {_BIG_LAYOUT} FROM big) SELECT key, off, CASE WHEN off < ssd THEN 'ssd' ELSE 'hdd' END AS tier, CASE WHEN off < ssd THEN off ELSE off - ssd END AS "local" FROM l WHERE ssd > 0''')
def q06_place(spark, d):
    rows = V.large(spark, d).select("key", F.expr("size div 2").alias("off"), placement.layout(F.col("size"), BIG_TIERS, True)["ssd"].alias("ssd")).where("ssd > 0")
    return rows.select("key", "off", placement.place(F.col("off"), F.col("ssd")).alias("p")).select("key", "off", "p.*")


_PLAN = f"""{V.BIG}, r AS (SELECT key, bucket, size // 3 AS off, size // 2 AS len FROM big), c AS (SELECT *, unnest(range(off // {STRIPE}, (off + len - 1) // {STRIPE} + 1)) AS chunk FROM r WHERE len > 0),
s AS (SELECT key, chunk, (((bucket::HUGEINT + chunk) % 18446744073709551616) % {DRIVES})::INTEGER AS drive, (chunk // {DRIVES}) * {STRIPE} + greatest(off, chunk * {STRIPE}) % {STRIPE} AS file_offset,
  least(off + len, (chunk + 1) * {STRIPE}) - greatest(off, chunk * {STRIPE}) AS seg_length, greatest(off, chunk * {STRIPE}) - off AS place FROM c)"""


def _plans(spark, d):
    reads = V.large(spark, d).select("key", "bucket", F.expr("size div 3").alias("off"), F.expr("size div 2").alias("len"))
    return placement.plan_reads(reads, "bucket", "off", "len", STRIPE, DRIVES)


@query(f"WITH {_PLAN} SELECT drive, count(*) AS segments, sum(seg_length)::BIGINT AS total, sum(file_offset % 1000003)::BIGINT AS offsets, sum(place % 1000003)::BIGINT AS places FROM s GROUP BY 1")
def q07_plan_reads(spark, d):
    by = _plans(spark, d).groupBy("drive")
    return by.agg(F.count("*").alias("segments"), F.sum("seg_length").alias("total"), F.sum(F.expr("file_offset % 1000003")).alias("offsets"), F.sum(F.expr("at % 1000003")).alias("places"))


@query(f"WITH {V.BIG} SELECT key, CASE WHEN size > 0 THEN least({DRIVES}, ceil(size / {STRIPE}::DOUBLE)) ELSE 0 END::INTEGER AS files, CASE WHEN size % 4096 = 0 THEN size ELSE (size // 4096 + 1) * 4096 END AS on_disk FROM big")
def q08_files_used(spark, d):
    return V.large(spark, d).select("key", placement.files_used(F.col("size"), STRIPE, DRIVES).alias("files"), placement.align_up(F.col("size")).alias("on_disk"))


@query(
    f"""WITH {V.OBJ}, p AS (SELECT size, (SELECT min(x) FROM (SELECT unnest([4096, 8192, 16384, 32768, 65536]) AS x) WHERE x >= size) AS given FROM obj WHERE size > 0)
SELECT given, count(*) AS objects, (count(*) * coalesce(given, 0))::BIGINT AS used FROM p GROUP BY given"""
)
def q08b_buddy_bytes(spark, d):
    given = V.objects(spark, d).where("size > 0").select(placement.buddy_bytes(F.col("size"), 65536).alias("given"))
    return given.groupBy("given").agg(F.count("*").alias("objects"), F.coalesce(F.sum("given"), F.lit(0)).alias("used"))


# HTTP

_CANON = "'/' || array_to_string(list_reduce(string_split({p}, '/'), lambda acc, x: CASE WHEN x = '..' THEN acc[1:len(acc) - 1] WHEN x IN ('', '.') THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]), '/')"
_HOST = "lower(regexp_replace(split_part(host, ':', 1), '\\.+$', ''))"
_PARTS = f"""{V.REQ}, u AS (SELECT *, split_part(target, '#', 1) AS plain FROM req), w AS (SELECT *, split_part(plain, '?', 1) AS raw FROM u), x AS (SELECT *, substr(plain, length(raw) + 1) AS query,
  url_decode(CASE WHEN raw = '' OR raw LIKE '%/' THEN raw || 'index.html' ELSE raw END) AS path, url_decode(raw) AS bare FROM w)"""


@query(f"WITH {V.REQ} SELECT id, url_decode(target) AS decoded FROM req")
def q09_percent_decode(spark, d):
    return V.requests(spark, d).select("id", http.percent_decode(F.col("target")).alias("decoded"))


@query(f"WITH {V.REQ} SELECT id, {_CANON.format(p='target')} AS path FROM req")
def q10_canonical_path(spark, d):
    return V.requests(spark, d).select("id", http.canonical_path(F.col("target")).alias("path"))


@query(f"WITH {_PARTS} SELECT id, {_CANON.format(p='path')} AS key FROM x")
def q11_key_path(spark, d):
    return V.requests(spark, d).select("id", http.derive_key(F.col("host"), F.col("target")).alias("key"))


@query(
    f"WITH {_PARTS} SELECT id, CASE WHEN {_HOST} = '' THEN NULL ELSE {_HOST} || {_CANON.format(p='path')} END AS vhost, {_CANON.format(p='path')} || query AS queried,"
    f" {_CANON.format(p='bare')} AS unindexed, regexp_replace({_CANON.format(p='path')}, '^/', '') AS stripped FROM x"
)
def q12_key_variants(spark, d):
    key = lambda **o: http.derive_key(F.col("host"), F.col("target"), http.KeyOptions(**o))
    return V.requests(spark, d).select("id", key(vhost=True).alias("vhost"), key(keep_query=True).alias("queried"), key(index_name="").alias("unindexed"), key(strip_slash=True).alias("stripped"))


@query(f"WITH {_PARTS}, y AS (SELECT id, target, substr({_CANON.format(p='path')}, 2) AS rel FROM x) SELECT id, {_CANON.format(p='rel')} AS file_key, lower(split_part(rel, '/', 1)) || {_CANON.format(p='''substr(rel, length(split_part(rel, '/', 1)) + 1)''')} AS vhost_key FROM y")
def q13_relpath_keys(spark, d):
    rel = V.requests(spark, d).select("id", F.substring(http.derive_key(F.col("host"), F.col("target")), F.lit(2), F.lit(1 << 20)).alias("rel"))
    return rel.select("id", http.derive_key_from_relpath(F.col("rel")).alias("file_key"), http.derive_key_from_relpath(F.col("rel"), http.KeyOptions(vhost=True)).alias("vhost_key"))


def _range(size: str) -> str:
    return f"""CASE doc_id % 14 WHEN 8 THEN ' bytes=1-2 ' WHEN 9 THEN 'bytes= 0 - 99' WHEN 10 THEN 'bytes=1000000000000000000-' WHEN 11 THEN 'bytes=0-18446744073709551615' WHEN 12 THEN 'bytes=-000000000000000000000000500' WHEN 13 THEN 'bytes=0-18446744073709551616' WHEN 0 THEN 'bytes=0-99' WHEN 1 THEN 'bytes=' || ({size} - 50) || '-' WHEN 2 THEN 'bytes=-500' WHEN 3 THEN 'bytes=999999999-' WHEN 4 THEN 'bytes=5-2' WHEN 5 THEN 'bytes=10-20,30-40' WHEN 6 THEN 'items=0-9' ELSE ' bytes=1-2' END"""


_EVAL_COLS = f"""CASE doc_id % 11 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'PUT' ELSE 'GET' END AS method, CASE doc_id % 5 WHEN 0 THEN NULL ELSE {_range('size')} END AS range_header,
 CASE doc_id % 9 WHEN 0 THEN '*' WHEN 1 THEN 'W/"x", ' || tag WHEN 2 THEN '"no"' END AS inm, doc_id % 13 <> 0 AS found, doc_id % 17 <> 0 AS host_ok"""


def _evaluated(spark, d):
    rows = V.objects(spark, d).withColumn("tag", identity.etag(F.col("size"), F.col("etag")))
    rows = rows.selectExpr("doc_id", "key", "size", "tag", *[c.strip() for c in _split_columns(_EVAL_COLS)])
    c = F.col
    return rows.withColumn("e", http.evaluate(c("method"), c("found"), c("key"), c("size"), c("tag"), c("range_header"), c("inm"), c("host_ok")))


def _split_columns(text: str) -> list[str]:
    """Comma-separated expressions; commas inside quotes, brackets or CASE don't part."""
    out, depth, quoted, now = [], 0, False, ""
    for ch in text:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not quoted and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


#: A byte range by its rules: blanks around the whole and around both ends.
_SPEC = "^[ \t]*bytes=[ \t]*([0-9]*)[ \t]*-[ \t]*([0-9]*)[ \t]*$"
_RANGE_SQL = f"""{V.OBJ}, t AS (SELECT *, '"' || lower(to_base(size, 16)) || '-' || lower(to_base(etag, 16)) || '"' AS tag FROM obj), h AS (SELECT *, {_EVAL_COLS} FROM t),
n AS (SELECT *, regexp_extract(range_header, '{_SPEC}', 1) AS ra, regexp_extract(range_header, '{_SPEC}', 2) AS rb FROM h),
k AS (SELECT *, CASE WHEN ra = '' AND rb <> '' AND try_cast(rb AS UBIGINT) > 0 THEN 'suffix' WHEN rb = '' AND try_cast(nullif(ra, '') AS UBIGINT) IS NOT NULL THEN 'from' WHEN ra <> '' AND try_cast(nullif(rb, '') AS UBIGINT) >= try_cast(ra AS UBIGINT) THEN 'closed' END AS kind,
  try_cast(nullif(ra, '') AS UBIGINT)::HUGEINT AS a, try_cast(nullif(rb, '') AS UBIGINT)::HUGEINT AS b FROM n),
v AS (SELECT *, CASE kind WHEN 'suffix' THEN CASE WHEN size > 0 THEN (size - least(b, size))::BIGINT END ELSE CASE WHEN a < size THEN a::BIGINT END END AS off FROM k),
z AS (SELECT *, CASE kind WHEN 'closed' THEN least(b, size - 1)::BIGINT - off + 1 ELSE size - off END AS len FROM v),
e AS (SELECT *, CASE WHEN NOT host_ok THEN 421 WHEN method NOT IN ('GET', 'HEAD') THEN 405 WHEN NOT found THEN 404 WHEN coalesce(contains(inm, '*') OR contains(inm, tag), false) THEN 304
  WHEN method = 'GET' AND kind IS NOT NULL AND off IS NULL THEN 416 WHEN method = 'GET' AND kind IS NOT NULL THEN 206 ELSE 200 END AS status FROM z)"""


@query(f"WITH {_RANGE_SQL} SELECT key, kind, (CASE kind WHEN 'suffix' THEN b WHEN 'from' THEN a WHEN 'closed' THEN a END)::VARCHAR AS a, (CASE kind WHEN 'closed' THEN b WHEN 'suffix' THEN 0 WHEN 'from' THEN 0 END)::VARCHAR AS b FROM k")
def q14_parse_range(spark, d):
    rows = _evaluated(spark, d).select("key", http.parse_range(F.col("range_header")).alias("r"))
    return rows.select("key", "r.kind", F.col("r.a").cast("string").alias("a"), F.col("r.b").cast("string").alias("b"))


@query(f"WITH {_RANGE_SQL} SELECT key, off, CASE WHEN off IS NOT NULL THEN len END AS len FROM z WHERE kind IS NOT NULL")
def q15_resolve_range(spark, d):
    rows = _evaluated(spark, d).withColumn("r", http.parse_range(F.col("range_header"))).where("r IS NOT NULL")
    return rows.select("key", http.resolve_range(F.col("r"), F.col("size")).alias("s")).select("key", "s.off", "s.len")


_MIME = "CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in http.TYPES.items()) + f" ELSE '{http.OCTETS}' END"
_TYPED = "SELECT *, regexp_extract(string_split(split_part({key}, '?', 1), '/')[-1], '^.+\\.([^.]{{1,8}})$', 1) AS ext FROM {rows}"


@query(f"WITH {V.OBJ}, m AS ({_TYPED.format(key='key', rows='obj')}) SELECT key, {_MIME} AS type FROM m")
def q16_content_type(spark, d):
    return V.objects(spark, d).select("key", http.content_type(F.col("key")).alias("type"))


@query(f"WITH {_RANGE_SQL} SELECT key, coalesce(contains(inm, '*') OR contains(inm, tag), false) AS matched FROM e")
def q17_none_match(spark, d):
    return _evaluated(spark, d).select("key", http.none_match(F.col("inm"), F.col("tag")).alias("matched"))


@query(
    f"WITH {_RANGE_SQL} SELECT key, status, CASE WHEN status = 206 THEN off ELSE 0 END AS body_off, CASE WHEN status = 206 THEN len WHEN status = 200 AND method <> 'HEAD' THEN size ELSE 0 END AS body_len,"
    " CASE status WHEN 206 THEN 'bytes ' || off || '-' || (off + len - 1) || '/' || size WHEN 416 THEN 'bytes */' || size END AS content_range FROM e"
)
def q18_status(spark, d):
    return _evaluated(spark, d).select("key", "e.*")


_NL = "chr(13) || chr(10)"


@query(
    f"""WITH {_RANGE_SQL}, m AS ({_TYPED.format(key='key', rows='e')}), l AS (SELECT *, {_MIME} AS type, {_NL} AS nl FROM m)
SELECT key, CASE status
  WHEN 200 THEN 'HTTP/1.1 200 OK' || nl || 'Content-Length: ' || size || nl || CASE WHEN size > 0 THEN 'Content-Type: ' || type || nl || 'Accept-Ranges: bytes' || nl ELSE '' END || 'ETag: ' || tag || nl || 'Connection: keep-alive'
  WHEN 206 THEN 'HTTP/1.1 206 Partial Content' || nl || 'Content-Range: bytes ' || off || '-' || (off + len - 1) || '/' || size || nl || 'Content-Length: ' || len || nl || 'Content-Type: ' || type || nl || 'ETag: ' || tag || nl || 'Connection: keep-alive'
  WHEN 304 THEN 'HTTP/1.1 304 Not Modified' || nl || 'ETag: ' || tag || nl || 'Connection: keep-alive'
  WHEN 416 THEN 'HTTP/1.1 416 Range Not Satisfiable' || nl || 'Content-Range: bytes */' || size || nl || 'Content-Length: 0' || nl || 'Connection: keep-alive'
  WHEN 404 THEN 'HTTP/1.1 404 Not Found' || nl || 'Content-Length: 0' || nl || 'Connection: keep-alive'
  WHEN 405 THEN 'HTTP/1.1 405 Method Not Allowed' || nl || 'Content-Length: 0' || nl || 'Allow: GET, HEAD' || nl || 'Connection: close'
  ELSE 'HTTP/1.1 421 Misdirected Request' || nl || 'Content-Length: 0' || nl || 'Connection: close' END || nl || nl AS head FROM l"""
)
def q19_response_head(spark, d):
    rows = _evaluated(spark, d).select("key", "size", "tag", "e.*")
    c = F.col
    return rows.select("key", http.response_head(c("status"), c("size"), c("body_len"), http.content_type(c("key")), c("tag"), c("content_range"), F.lit(True)).alias("head"))


def _bodies(spark, d):
    """key, body (hex) of the 206 answers, whole."""
    rows = _evaluated(spark, d).where("e.status = 206").select("key", "doc_id", "e.body_off", "e.body_len")
    texts = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("value"))
    return rows.join(texts, "doc_id").select("key", F.lower(F.hex(F.expr("substring(value, int(body_off) + 1, int(body_len))"))).alias("body"))


_BODIES = f"WITH {_RANGE_SQL} SELECT key, lower(hex(encode(text))[2 * off + 1:2 * (off + len)]) AS body FROM e JOIN (SELECT doc_id, coalesce(text, '') AS text FROM documents) USING (doc_id) WHERE status = 206"


@query(_BODIES)
def q20_ranged_bytes(spark, d):
    return _bodies(spark, d)


@query(_BODIES)
def q20_ranged_bytes_whole(spark, d):
    """q20_ranged_bytes, under the name that it had while that showed 64 bytes of a range."""
    return _bodies(spark, d)


# protocol

_LINE = """CASE seq % 11 WHEN 7 THEN 'cas ' || key || ' 1 0 5 18446744073709551615' WHEN 8 THEN 'set ' || key || ' 0007 00000000000000000000009 1234567890123456789' WHEN 9 THEN 'set ' || key || ' 1 1 18446744073709551616'
 WHEN 10 THEN 'cas ' || key || ' 4294967295 4294967295 10000000000000000000 0' WHEN 0 THEN verb || ' ' || key || ' ' || flags || '  ' || exptime || ' ' || bytes WHEN 1 THEN 'set ' || key || ' ' || flags || ' ' || exptime || ' ' || bytes || ' noreply'
 WHEN 2 THEN 'cas ' || key || ' 1 0 5 ' || seq WHEN 3 THEN 'set ' || key || ' a b c' WHEN 4 THEN 'get ' || key || ' other' WHEN 5 THEN 'incr ' || key || ' 1' ELSE 'set ' || key || ' 4294967296 0 1' END"""


@query(
    f"""WITH {V.CMD}, l AS (SELECT seq, list_filter(string_split({_LINE}, ' '), lambda x: x <> '')[1:7] AS t FROM cmd),
p AS (SELECT *, t[1] IN ('set', 'add', 'replace', 'cas') AS st, t[1] IN ('get', 'gets', 'delete') AS kd FROM l),
n AS (SELECT *, CASE WHEN st THEN try_cast(t[3] AS UINTEGER) IS NOT NULL AND try_cast(t[4] AS UINTEGER) IS NOT NULL AND try_cast(t[5] AS UBIGINT) IS NOT NULL AND (t[1] <> 'cas' OR try_cast(t[6] AS UBIGINT) IS NOT NULL)
  WHEN kd THEN t[2] IS NOT NULL ELSE t[1] IN ('version', 'quit', 'stats') END AS ok FROM p)
SELECT seq, ok, CASE WHEN ok THEN t[1] END AS verb, CASE WHEN ok AND (st OR kd) THEN t[2] END AS key, CASE WHEN ok AND st THEN t[3]::BIGINT END AS flags, CASE WHEN ok AND st THEN t[4]::BIGINT END AS exptime,
  CASE WHEN ok AND st THEN t[5]::UBIGINT::VARCHAR END AS bytes, CASE WHEN ok AND t[1] = 'cas' THEN t[6]::UBIGINT::VARCHAR END AS cas, ok AND (st OR t[1] = 'delete') AND coalesce(CASE t[1] WHEN 'cas' THEN t[7] WHEN 'delete' THEN t[3] ELSE t[6] END = 'noreply', false) AS noreply FROM n"""
)
def q21_parse_classic(spark, d):
    return V.commands(spark, d).select("seq", protocol.parse_classic(F.expr(_LINE)).alias("c")).select("seq", "c.*").withColumns({c: F.col(c).cast("string") for c in ("bytes", "cas")})


_META_LINE = """CASE seq % 6 WHEN 0 THEN 'mg ' || key || ' v f s t c k T90 Oabc' WHEN 1 THEN 'ms ' || key || ' ' || bytes || ' F7 T300 C' || (18446744073709500000 + seq) || ' ME q' WHEN 2 THEN 'mg ' || key || ' Z' WHEN 3 THEN 'md ' || key || ' C1 C2 k' WHEN 4 THEN 'mn' ELSE 'ms ' || key || ' x' END"""


@query(
    f"""WITH {V.CMD} SELECT seq, seq % 6 NOT IN (2, 5) AS ok, CASE seq % 6 WHEN 0 THEN 'mg' WHEN 1 THEN 'ms' WHEN 3 THEN 'md' WHEN 4 THEN 'mn' END AS verb, CASE WHEN seq % 6 IN (0, 1, 3) THEN key END AS key,
  CASE WHEN seq % 6 = 1 THEN bytes::VARCHAR END AS datalen, CASE seq % 6 WHEN 0 THEN 'vfstck' WHEN 1 THEN '' WHEN 3 THEN 'k' END AS rf, seq % 6 = 1 AS q, CASE WHEN seq % 6 = 1 THEN 7 END::BIGINT AS f, CASE seq % 6 WHEN 0 THEN 90 WHEN 1 THEN 300 END::BIGINT AS t,
  CASE seq % 6 WHEN 1 THEN (18446744073709500000 + seq)::VARCHAR WHEN 3 THEN '2' END AS c, CASE seq % 6 WHEN 0 THEN 'S' WHEN 1 THEN 'E' WHEN 3 THEN 'S' END AS mode, CASE seq % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 3 THEN '' END AS opaque FROM cmd"""
)
def q22_parse_meta(spark, d):
    rows = V.commands(spark, d).select("seq", protocol.parse_meta(F.expr(_META_LINE)).alias("m")).select("seq", "m.*")
    return rows.withColumns({"rf": F.array_join("rf", "")} | {c: F.col(c).cast("string") for c in ("datalen", "c")})


@query(
    f"WITH {V.CMD}, e AS (SELECT seq, now, CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN exptime WHEN 2 THEN 2592000 ELSE 2592001 END AS e, CASE seq % 3 WHEN 0 THEN -5 WHEN 1 THEN exptime END AS ttl FROM cmd)"
    " SELECT seq, (CASE WHEN e = 0 THEN 0 WHEN e > 2592000 THEN e ELSE now + e END)::BIGINT AS expiry, (CASE WHEN ttl IS NULL THEN 0 WHEN ttl < 0 THEN 1 WHEN ttl = 0 THEN 0 WHEN ttl > 2592000 THEN ttl ELSE now + ttl END)::BIGINT AS meta_expiry FROM e"
)
def q23_expiry(spark, d):
    e = F.expr("CASE seq % 4 WHEN 0 THEN 0L WHEN 1 THEN exptime WHEN 2 THEN 2592000L ELSE 2592001L END")
    ttl = F.expr("CASE seq % 3 WHEN 0 THEN -5L WHEN 1 THEN exptime END")
    return V.commands(spark, d).select("seq", protocol.expiry(e, F.col("now")).alias("expiry"), protocol.meta_expiry(ttl, F.col("now")).alias("meta_expiry"))


@query(
    f"WITH {V.OBJ} SELECT key, 'VALUE ' || key || ' ' || flags || ' ' || size || ' ' || etag AS value_line, ' f' || flags || ' s' || size || ' t' || CASE WHEN expiry = 0 THEN -1 ELSE greatest(expiry - {NOW}, 0) END || ' c' || etag || ' k' || key || ' Oq' AS meta_line FROM obj"
)
def q24_reply_text(spark, d):
    c = F.col
    rf = F.array(*[F.lit(x) for x in "fstck"])
    return V.objects(spark, d).select("key", protocol.value_header(c("key"), c("flags"), c("size"), c("etag")).alias("value_line"), protocol.meta_flags(rf, c("flags"), c("size"), c("expiry"), c("etag"), c("key"), F.lit("q"), F.lit(NOW)).alias("meta_line"))


# probes as joins

_TWO = f"WITH {V.OBJ}, {V.PROBE}"


@query(f"{_TWO} SELECT p.seq, o.size, o.flags, o.expiry, o.etag FROM probe p LEFT JOIN obj o USING (digest)")
def q25_lookup(spark, d):
    return catalog.lookup(V.probes(spark, d).select("seq", "digest"), V.objects(spark, d)).drop("digest")


@query(f"{_TWO} SELECT seq, key FROM probe WHERE digest IN (SELECT digest FROM obj)")
def q26_contains(spark, d):
    return catalog.contains(V.probes(spark, d).select("seq", "key", "digest"), V.objects(spark, d)).drop("digest")


@query(f"{_TWO} SELECT digest, arg_min(size, seq) AS size, arg_min(flags, seq) AS flags, 0::BIGINT AS expiry, arg_min(etag, seq) AS etag FROM probe WHERE digest NOT IN (SELECT digest FROM obj) GROUP BY digest")
def q27_add(spark, d):
    return catalog.add(V.probes(spark, d), V.objects(spark, d))


@query(f"{_TWO} SELECT digest, arg_max(size, seq) AS size, arg_max(flags, seq) AS flags, 0::BIGINT AS expiry, arg_max(etag, seq) AS etag FROM probe WHERE digest IN (SELECT digest FROM obj) GROUP BY digest")
def q28_replace(spark, d):
    return catalog.replace(V.probes(spark, d), V.objects(spark, d))


@query(f"{_TWO} SELECT p.seq, CASE WHEN o.etag IS NULL OR NOT (o.expiry = 0 OR o.expiry > {NOW}) THEN 'NOT_FOUND' WHEN o.etag <> p.etag THEN 'EXISTS' ELSE 'STORED' END AS reply FROM probe p LEFT JOIN obj o USING (digest)")
def q29_cas(spark, d):
    asked = V.probes(spark, d).select("seq", "digest", F.col("etag").alias("token"))
    return catalog.compare_and_swap(asked, V.objects(spark, d), NOW).select("seq", "reply")


@query(f"WITH {V.OBJ} SELECT count(*) AS reaped, sum(size)::BIGINT AS freed FROM obj WHERE expiry <> 0 AND expiry <= {NOW}")
def q30_reap(spark, d):
    return catalog.expired(V.objects(spark, d), NOW).agg(F.count("*").alias("reaped"), F.sum("size").alias("freed"))


@query(f"WITH {V.OBJ} SELECT key FROM obj WHERE expiry = 0 OR expiry > {NOW}")
def q30b_live(spark, d):
    return catalog.reap(V.objects(spark, d), NOW).select("key")


@query(
    f"{_TWO}, u AS (SELECT digest, -1 AS seq, size, flags, expiry, etag FROM obj UNION ALL SELECT digest, seq, size, flags, expiry, etag FROM probe) SELECT digest, arg_max(size, seq) AS size, arg_max(flags, seq) AS flags, arg_max(expiry, seq) AS expiry, arg_max(etag, seq) AS etag FROM u GROUP BY digest"
)
def q31_upsert(spark, d):
    return catalog.upsert(V.objects(spark, d), V.probes(spark, d))


@query(f"{_TWO} SELECT key FROM obj WHERE digest NOT IN (SELECT digest FROM probe)")
def q31b_erase(spark, d):
    return catalog.erase(V.objects(spark, d), V.probes(spark, d)).select("key")


# replay without expiry

_LIVE = f"""{V.CMD}, b AS (SELECT *, coalesce(last_value(CASE WHEN verb IN ('set', 'add') THEN true WHEN verb = 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY digest ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS live FROM cmd),
r AS (SELECT *, verb = 'set' OR (verb = 'add' AND NOT live) OR (verb = 'replace' AND live) AS stored FROM b),
a AS (SELECT *, CASE verb WHEN 'delete' THEN CASE WHEN live THEN 'DELETED' ELSE 'NOT_FOUND' END WHEN 'get' THEN CASE WHEN live THEN 'VALUE' ELSE 'END' END ELSE CASE WHEN stored THEN 'STORED' ELSE 'NOT_STORED' END END AS reply FROM r)"""


def _answered(spark, d):
    rows = replay.live_before(V.commands(spark, d))
    live = F.col("live")
    return rows.withColumn("stored", replay.stores(live)).withColumn("reply", replay.reply(live))


@query(f"WITH {_LIVE} SELECT seq, live FROM a")
def q32_live_before(spark, d):
    return replay.live_before(V.commands(spark, d)).select("seq", "live")


@query(f"WITH {_LIVE} SELECT verb, reply, count(*) AS n FROM a GROUP BY ALL")
def q33_reply_counts(spark, d):
    return _answered(spark, d).groupBy("verb", "reply").agg(F.count("*").alias("n"))


_FINAL = "s AS (SELECT digest, arg_max(size, seq) AS size, arg_max(flags, seq) AS flags, max(seq) AS etag, arg_max(gone, seq) AS gone FROM (SELECT digest, seq, bytes AS size, flags, verb = 'delete' AS gone FROM {rows} WHERE stored OR verb = 'delete') GROUP BY digest)"


@query(f"WITH {_LIVE}, {_FINAL.format(rows='a')} SELECT digest, size, flags, etag FROM s WHERE NOT gone")
def q34_final_store(spark, d):
    changes = _answered(spark, d).where("stored OR verb = 'delete'")
    last = changes.groupBy("digest").agg(F.max_by(F.struct(F.col("bytes").alias("size"), "flags", F.col("seq").alias("etag"), "verb"), "seq").alias("s"))
    return last.where("s.verb <> 'delete'").select("digest", "s.size", "s.flags", "s.etag")


@query(f"WITH {_LIVE} SELECT seq, lag(seq) OVER (PARTITION BY digest ORDER BY seq) AS previous FROM a WHERE stored")
def q35_previous_version(spark, d):
    return replay.previous_version(_answered(spark, d).where("stored")).select("seq", "previous")


# replay with expiry

_FOLD = f"""RECURSIVE {V.CMD}, o AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY seq) AS i FROM cmd),
f AS (SELECT digest, 0::BIGINT AS i, 0::BIGINT AS seq, ''::VARCHAR AS reply, false AS stored, false AS present, 0::BIGINT AS size, 0::BIGINT AS flags, 0::BIGINT AS expiry, 0::BIGINT AS etag FROM (SELECT DISTINCT digest FROM cmd)
  UNION ALL SELECT digest, i, seq, reply, stored, CASE WHEN verb = 'delete' THEN false ELSE present OR stored END, CASE WHEN stored THEN bytes ELSE size END, CASE WHEN stored THEN cflags ELSE flags END, CASE WHEN stored THEN cexpiry ELSE expiry END, CASE WHEN stored THEN seq ELSE etag END
  FROM (SELECT *, CASE verb WHEN 'get' THEN CASE WHEN live THEN 'VALUE ' || key || ' ' || flags || ' ' || size ELSE 'END' END WHEN 'delete' THEN CASE WHEN present THEN 'DELETED' ELSE 'NOT_FOUND' END ELSE CASE WHEN stored THEN 'STORED' ELSE 'NOT_STORED' END END AS reply
    FROM (SELECT *, verb = 'set' OR (verb = 'add' AND NOT live) OR (verb = 'replace' AND live) AS stored FROM (SELECT f.digest, o.i, o.seq, o.verb, o.key, o.bytes, o.flags AS cflags, o.expiry AS cexpiry, f.present, f.size, f.flags, f.expiry, f.etag,
      f.present AND (f.expiry = 0 OR f.expiry > o.now) AS live FROM f JOIN o ON f.digest = o.digest AND o.i = f.i + 1))))"""


@query(f"WITH {_FOLD} SELECT seq, reply, stored FROM f WHERE i > 0")
def q36_replies(spark, d):
    return machine.replay(V.full_commands(spark, d)).select("seq", "reply", "stored")


@query(f"WITH {_FOLD}, l AS (SELECT digest, max(i) AS i FROM f GROUP BY digest) SELECT digest, size, flags, expiry, etag FROM f JOIN l USING (digest, i) WHERE present")
def q37_final_store_ttl(spark, d):
    return replay.final_state(machine.replay(V.full_commands(spark, d)))


@query(f"WITH {_LIVE} SELECT seq, CASE WHEN stored THEN sum(stored::INTEGER) OVER (ORDER BY seq) END::BIGINT AS generation FROM a")
def q38_generations(spark, d):
    return replay.numbered(_answered(spark, d), F.col("stored"), "seq", "generation").select("seq", "generation")


@query()
def q39_cas_and_meta(spark, d):
    """Tokens name the version five commands before; every third command is a meta one."""
    rows = V.full_commands(spark, d).withColumn("token", F.expr("CASE WHEN seq % 4 = 0 THEN seq - 5 END"))
    verb = F.expr("CASE WHEN seq % 3 = 0 THEN CASE verb WHEN 'get' THEN 'mg' WHEN 'delete' THEN 'md' ELSE 'ms' END WHEN seq % 4 = 0 AND verb = 'set' THEN 'cas' ELSE verb END")
    rows = rows.withColumn("verb", verb).withColumn("rf", F.lit("fstck")).withColumn("mode", F.expr("CASE seq % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'R' ELSE 'S' END")).withColumn("ttl", F.expr("CASE seq % 7 WHEN 0 THEN -1L WHEN 1 THEN 60L END"))
    return machine.replay(rows).select("seq", "reply", "stored")


@query(f"WITH {_FOLD} SELECT seq, reply, stored FROM f WHERE i > 0")
def q39b_stream_replay(spark, d):
    """The log as a stream of files, through keyed state; the answers are those of the batch."""
    from tierstone.streaming import machine as stream

    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tierstone-')}"
    root = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.write_log(V.full_commands(spark, d), f"{root}/log")
    replies = stream.replay_stream(stream.read_commands(spark, f"{root}/log", stream.files_for_batch(spark, f"{root}/log")))
    return stream.run_available(replies, f"{root}/replies", f"{root}/checkpoint").select("seq", "reply", "stored")


# metrics

_COUNTED = """c AS (SELECT {by} sum((reply = 'VALUE')::INTEGER)::BIGINT AS get_hits, sum((verb = 'get' AND reply <> 'VALUE')::INTEGER)::BIGINT AS get_misses, sum((verb IN ('set', 'add', 'replace') AND stored)::INTEGER)::BIGINT AS sets_stored,
  sum((verb IN ('set', 'add', 'replace') AND NOT stored)::INTEGER)::BIGINT AS sets_rejected, sum(CASE WHEN reply = 'VALUE' THEN bytes ELSE 0 END)::BIGINT AS bytes_served, sum(CASE WHEN verb IN ('set', 'add', 'replace') AND stored THEN bytes ELSE 0 END)::BIGINT AS bytes_stored FROM a {group})"""


@query(f"WITH {_LIVE}, {_COUNTED.format(by='', group='')}, l AS (SELECT get_hits + get_misses AS cmd_get, sets_stored + sets_rejected AS cmd_set, * FROM c) SELECT name, value FROM (UNPIVOT l ON COLUMNS(*) INTO NAME name VALUE value)")
def q40_stats_report(spark, d):
    return metrics.report(metrics.counters(_answered(spark, d)))


@query(f"WITH {_LIVE}, {_COUNTED.format(by='now // 3600 AS hour,', group='GROUP BY 1')} SELECT * FROM c")
def q41_counters_by_hour(spark, d):
    return metrics.counters(_answered(spark, d).withColumn("hour", F.expr("now div 3600")), "hour")


@query(
    "WITH s AS (SELECT event_type, list_sort(list(floor(value * 1000)::BIGINT)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1), p AS (SELECT unnest([50.0, 90.0, 99.0])::DOUBLE AS percent)"
    " SELECT event_type, percent, v[(floor(percent / 100 * (len(v) - 1)))::BIGINT + 1] AS value FROM s, p"
)
def q42_percentiles(spark, d):
    rows = V.table(spark, d, "events").select("event_type", F.floor(F.col("value") * 1000).alias("v"))
    return metrics.nearest_rank(rows, "event_type", "v", (50, 90, 99))


@query(f"WITH {V.CMD} SELECT verb, count(*) / 60.0::DOUBLE AS ops_per_s, sum(bytes)::DOUBLE / 1048576.0 / 60.0 AS mib_per_s, sum(bytes)::DOUBLE / 1048576.0 / 60.0 * 8 / 1024 AS gib_per_s FROM cmd GROUP BY verb")
def q43_throughput(spark, d):
    return metrics.throughput(V.commands(spark, d), "verb", "bytes", 60.0)


@query(f"WITH {V.CMD}, g AS (SELECT seq, key, now - lag(now) OVER (PARTITION BY key ORDER BY now, seq) AS gap FROM cmd) SELECT seq, key, gap FROM g WHERE gap >= 30000")
def q44_stalls(spark, d):
    return metrics.stalls(V.commands(spark, d), "key", "now", 30000).select("seq", "key", "gap")


@query(f"WITH {V.CMD} SELECT (max(now) - min(now))::BIGINT AS uptime, count(DISTINCT key) AS connections, (count(*) FILTER (verb IN ('add', 'set')) - count(*) FILTER (verb = 'delete'))::BIGINT AS gauge FROM cmd")
def q45_gauges(spark, d):
    opens, closes = F.count_if(F.col("verb").isin("add", "set")), F.count_if(F.col("verb") == "delete")
    return V.commands(spark, d).agg((F.max("now") - F.min("now")).alias("uptime"), F.count_distinct("key").alias("connections"), (opens - closes).alias("gauge"))


# eviction


def _trace(spark, d):
    rows = V.commands(spark, d)
    op = F.expr("CASE verb WHEN 'get' THEN 'get' WHEN 'delete' THEN 'delete' ELSE 'set' END")
    return rows.select("seq", op.alias("op"), "key", F.pmod("bytes", F.lit(40_000)).alias("size"))


@query()
def q46_head_cache(spark, d):
    return eviction.simulate(_trace(spark, d), {"heads": eviction.CacheConfig()})


@query()
def q47_object_bound(spark, d):
    return eviction.simulate(_trace(spark, d), {"bound": eviction.CacheConfig(max_objects=20)})


@query()
def q48_hit_ratio_by_size(spark, d):
    sizes = {f"{n}": eviction.CacheConfig(memory=n * 65536, max_objects=n * 6) for n in (1, 2, 4, 8, 16)}
    gets = eviction.simulate(_trace(spark, d), sizes).where("op = 'get'")
    return gets.groupBy("cache").agg(F.count("*").alias("gets"), F.count_if(F.col("outcome") != "miss").alias("hits"), F.count_if(F.col("outcome") == "head").alias("head_hits"))
