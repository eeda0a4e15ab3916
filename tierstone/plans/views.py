"""The tables of the queries: objects, large objects, requests, commands and probes, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.config import Tiers
from tierstone.functions.identity import bucket, digest
from tierstone.functions.protocol import expiry

#: Tiers that suit the documents' sizes.
SMALL = Tiers(4096, 16384)
NOW = 1_700_500_000
EXT = "CASE lang WHEN 'en' THEN 'html' WHEN 'de' THEN 'css' WHEN 'fr' THEN 'JS' ELSE 'x' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest, key, size, flags, etag, expiry of documents as stored objects."""
    key = F.expr(f"concat('/', source, '/', doc_id, '.', {EXT})")
    return table(spark, sf_dir, "documents").select(
        digest(key).alias("digest"),
        key.alias("key"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.pmod("doc_id", F.lit(7)).cast("long").alias("flags"),
        (F.col("doc_id") + 1).alias("etag"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 0L ELSE 1700000000 + doc_id * 1000 END").alias("expiry"),
        "doc_id",
    )


OBJ = f"""obj AS (SELECT sha256(key) AS digest, * FROM (SELECT '/' || source || '/' || doc_id || '.' || {EXT} AS key, octet_length(encode(coalesce(text, '')))::BIGINT AS size,
  doc_id % 7 AS flags, doc_id + 1 AS etag, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1700000000 + doc_id * 1000 END AS expiry, doc_id FROM documents))"""


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, digest, bucket, size of order lines as objects of up to some hundred MiB."""
    key = F.expr("concat('/', l_orderkey, '/', l_linenumber)")
    lines = table(spark, sf_dir, "lineitem").select(key.alias("key"), digest(key).alias("digest"), F.floor(F.col("l_extendedprice") * F.col("l_quantity") * 20).alias("size"))
    return lines.withColumn("bucket", bucket(F.col("digest")))


_BUCKET = "('0x' || array_to_string(list_reverse(regexp_extract_all(substr(digest, 1, 16), '..')), ''))::UBIGINT"
BIG = f"""big AS (SELECT *, {_BUCKET} AS bucket FROM (SELECT *, sha256(key) AS digest FROM (SELECT '/' || l_orderkey || '/' || l_linenumber AS key, floor(l_extendedprice * l_quantity * 20)::BIGINT AS size FROM lineitem)))"""

#: Request targets that the pages do not have.
HARD = (
    ("a.test", "/a/b/../c"), ("a.test", "//a///b"), ("a.test", "/../../etc/passwd"), ("WWW.Example.COM:8080", "/x"), ("", "/y"), ("a.test..", "/a/../"), ("a.test", ""), ("a.test", "/a%2fb/%41%zz+c"),
    ("a.test", "/p?q=1/2#f"), ("a.test", "/p#f?q"), ("a.test", "/d/?k=%41"), ("a.test", "/./x/."), ("A", "/%2e%2e/x"),
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, host, target, method, range, inm of pages' urls and of the hard cases."""
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("page_id").alias("id"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1).alias("target"))
    hard = spark.createDataFrame([(-1 - i, h, t) for i, (h, t) in enumerate(HARD)], "id long, host string, target string")
    return pages.unionByName(hard)


_HARD_SQL = " UNION ALL ".join(f"SELECT {-1 - i}::BIGINT, '{h}', '{t}'" for i, (h, t) in enumerate(HARD))
REQ = f"""req AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS target FROM pages WHERE url IS NOT NULL UNION ALL {_HARD_SQL})"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, now, key, digest, verb, bytes, exptime, flags and expiry of the events as a log of commands."""
    key = F.concat(F.lit("u:"), F.col("user_id").cast("string"))
    verb = F.expr("CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'set' WHEN 'click' THEN 'replace' ELSE 'get' END")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("now"),
        key.alias("key"),
        digest(key).alias("digest"),
        verb.alias("verb"),
        F.floor(F.col("value") * 1024).alias("bytes"),
        (F.get_json_object("props", "$.k").cast("long") * 3600).alias("exptime"),
        F.pmod("event_id", F.lit(65536)).alias("flags"),
    )
    return rows.withColumn("expiry", expiry(F.col("exptime"), F.col("now")))


def full_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every column of the state machine."""
    none = lambda t: F.lit(None).cast(t)
    return commands(spark, sf_dir).drop("expiry").select(
        "*", none("long").alias("token"), F.lit(False).alias("noreply"), none("string").alias("rf"), none("string").alias("mode"), none("long").alias("ttl"), F.lit("").alias("opaque"), F.lit(False).alias("quiet"), F.lit(True).alias("good")
    )


CMD = """cmd AS (SELECT *, CASE WHEN exptime = 0 THEN 0 WHEN exptime > 2592000 THEN exptime ELSE now + exptime END AS expiry FROM (
  SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS now, 'u:' || user_id AS key, sha256('u:' || user_id) AS digest,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'set' WHEN 'click' THEN 'replace' ELSE 'get' END AS verb,
  floor(value * 1024)::BIGINT AS bytes, (props->>'$.k')::BIGINT * 3600 AS exptime, event_id % 65536 AS flags FROM events))"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, digest and a would-be version, of orders that name documents by number: some are there, some are not."""
    key = F.expr("concat('/src', o_orderkey % 20, '/', o_orderkey % 1500, '.html')")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), key.alias("key"), digest(key).alias("digest"), F.floor("o_totalprice").alias("size"), F.pmod("o_custkey", F.lit(7)).alias("flags"), (F.pmod("o_orderkey", F.lit(1500)) + F.pmod("o_custkey", F.lit(2))).alias("etag"))
    return rows.withColumn("expiry", F.lit(0).cast("long"))


PROBE = """probe AS (SELECT *, sha256(key) AS digest, 0::BIGINT AS expiry FROM (SELECT o_orderkey AS seq, '/src' || (o_orderkey % 20) || '/' || (o_orderkey % 1500) || '.html' AS key, floor(o_totalprice)::BIGINT AS size, o_custkey % 7 AS flags,
  o_orderkey % 1500 + o_custkey % 2 AS etag FROM orders))"""
