"""Probes of the store as joins on the digest. No side is hinted: Spark picks the join by size, and splits skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("size", "flags", "expiry", "etag")


def lookup(probes: DataFrame, objects: DataFrame) -> DataFrame:
    return probes.join(objects.select("digest", *META), "digest", "left")


def contains(probes: DataFrame, objects: DataFrame) -> DataFrame:
    return probes.join(objects.select("digest"), "digest", "left_semi")


def live_rows(objects: DataFrame, now) -> DataFrame:
    return objects.where((F.col("expiry") == 0) | (F.col("expiry") > now))


def add(new: DataFrame, objects: DataFrame) -> DataFrame:
    """New rows whose digest is absent; the first by seq of equal ones."""
    first = new.groupBy("digest").agg(F.min_by(F.struct(*META), "seq").alias("m")).select("digest", "m.*")
    return first.join(objects.select("digest"), "digest", "left_anti")


def replace(new: DataFrame, objects: DataFrame) -> DataFrame:
    """New rows whose digest is present; the last by seq of equal ones."""
    last = new.groupBy("digest").agg(F.max_by(F.struct(*META), "seq").alias("m")).select("digest", "m.*")
    return last.join(objects.select("digest"), "digest", "left_semi")


def compare_and_swap(commands: DataFrame, objects: DataFrame, now) -> DataFrame:
    """reply for each command with a token: NOT_FOUND, EXISTS or STORED."""
    got = lookup(commands, objects)
    is_live = F.col("etag").isNotNull() & ((F.col("expiry") == 0) | (F.col("expiry") > now))
    return got.withColumn("reply", F.when(~is_live, "NOT_FOUND").when(F.col("etag") != F.col("token"), "EXISTS").otherwise("STORED"))


def expired(objects: DataFrame, now) -> DataFrame:
    return objects.where((F.col("expiry") != 0) & (F.col("expiry") <= now))


def reap(objects: DataFrame, now) -> DataFrame:
    return live_rows(objects, now)


def touch(objects: DataFrame, touched: DataFrame) -> DataFrame:
    """objects with the expiry that touched (digest, new_expiry) gives; digests that are absent do nothing."""
    return objects.join(touched, "digest", "left").withColumn("expiry", F.coalesce("new_expiry", "expiry")).drop("new_expiry")


def upsert(objects: DataFrame, stores: DataFrame) -> DataFrame:
    """The last version of every digest: stores (with seq) over what was there. One shuffle, with a partial aggregate before it."""
    rows = objects.select("digest", *META, F.lit(-1).cast("long").alias("seq")).unionByName(stores.select("digest", *META, "seq"))
    return rows.groupBy("digest").agg(F.max_by(F.struct(*META), "seq").alias("m")).select("digest", "m.*")


def erase(objects: DataFrame, keys: DataFrame) -> DataFrame:
    return objects.join(keys.select("digest"), "digest", "left_anti")


def write_snapshot(objects: DataFrame, path: str) -> None:
    """A new snapshot under a path of its own: readers of the last one keep it, and a job that fails publishes nothing."""
    objects.write.mode("error").parquet(path)


def set_head(objects: DataFrame, heads: DataFrame) -> DataFrame:
    """objects with the head that heads (distinct digests, new_head) gives; digests that are absent do nothing."""
    return objects.join(heads, "digest", "left").withColumn("head", F.coalesce("new_head", "head")).drop("new_head")


def classify_gets(gets: DataFrame, objects: DataFrame, now) -> DataFrame:
    """outcome for each get: hit, absent or expired; the last two are misses."""
    got = lookup(gets, objects)
    is_live = (F.col("expiry") == 0) | (F.col("expiry") > now)
    return got.withColumn("outcome", F.when(F.col("etag").isNull(), "absent").when(is_live, "hit").otherwise("expired"))
