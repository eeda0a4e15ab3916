"""The library's scalar functions under SQL names. They are SQL functions, which Catalyst inlines; no Python runs in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments, result and body.
FUNCTIONS = (
    ("object_digest", "k STRING", "STRING", "sha2(k, 256)"),
    ("object_shard", "digest STRING", "INT", "int(conv(substring(digest, 1, 2), 16, 10))"),
    ("object_etag", "size BIGINT, version BIGINT", "STRING", """concat('"', lower(hex(size)), '-', lower(hex(version)), '"')"""),
    ("align_up", "n BIGINT", "BIGINT", "(n + 4095) & -4096"),
    ("expiry_of", "exptime BIGINT, now_s BIGINT", "BIGINT", "CASE WHEN exptime = 0 THEN 0 WHEN exptime > 2592000 THEN exptime ELSE now_s + exptime END"),
    ("is_live", "expiry BIGINT, now_s BIGINT", "BOOLEAN", "expiry = 0 OR expiry > now_s"),
)


def register(spark: SparkSession) -> None:
    """Temporary functions of the session; those of an earlier call are replaced."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
