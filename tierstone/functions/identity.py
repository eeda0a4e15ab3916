"""Object identity: digest, bucket, shard, entity tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARD_BITS = 8


def digest(key: Column) -> Column:
    """SHA-256 of the key's bytes in lower-case hex: the store never keeps the key itself."""
    return F.sha2(key, 256)


def bucket(hex_digest: Column) -> Column:
    """The digest's first 8 bytes as a little-endian unsigned number. The bytes are turned as pairs of hex digits."""
    pairs = F.regexp_extract_all(F.substring(hex_digest, 1, 16), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")


def shard(hex_digest: Column, bits: int = SHARD_BITS) -> Column:
    """The low bits of the bucket: up to 8, they are in the digest's first byte."""
    if not 0 <= bits <= 8:
        raise ValueError("0 to 8 bits")
    return F.conv(F.substring(hex_digest, 1, 2), 16, 10).cast("int").bitwiseAND((1 << bits) - 1)


def etag(size: Column, generation: Column) -> Column:
    return F.concat(F.lit('"'), F.lower(F.hex(size)), F.lit("-"), F.lower(F.hex(generation)), F.lit('"'))
