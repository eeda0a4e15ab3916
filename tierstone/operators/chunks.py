"""Values as tables of chunks: cut into stripes over drives, and ranges gathered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.functions.placement import drive_of


def to_chunks(values: DataFrame, stripe: int, drives: int) -> DataFrame:
    """digest, chunk, drive, bytes for each stripe of values (digest, bucket, value). Null and empty values have none."""
    size = F.octet_length("value")
    cut = values.where(size > 0).select("digest", "bucket", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(octet_length(value) - 1) div {stripe}"))).alias("chunk"))
    return cut.select("digest", "chunk", drive_of(F.col("bucket"), F.col("chunk"), drives).alias("drive"), F.expr(f"substring(value, int(chunk * {stripe}) + 1, {stripe})").alias("bytes"))


def gather(chunks: DataFrame, reads: DataFrame, stripe: int) -> DataFrame:
    """read, value for reads (read, digest, off, len; ids are distinct): the range's bytes in order. A group holds the chunks of one read, so a read should fit a task; what lies behind the end is left out, and ranges without a byte give no row."""
    asked = reads.where("len > 0").select("read", "digest", "off", "len", F.expr(f"explode(sequence(off div {stripe}, (off + len - 1) div {stripe}))").alias("chunk"))
    got = asked.join(chunks.select("digest", "chunk", "bytes"), ["digest", "chunk"])
    # each chunk is cut to the range before it is shuffled
    start = F.greatest(F.col("off") - F.col("chunk") * stripe, F.lit(0))
    stop = F.least(F.col("off") + F.col("len") - F.col("chunk") * stripe, F.lit(stripe))
    cut = got.select("read", F.struct("chunk", F.substring("bytes", (start + 1).cast("int"), (stop - start).cast("int")).alias("b")).alias("p"))
    whole = cut.groupBy("read").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    value = F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["b"]))
    return whole.select("read", value.alias("value")).where(F.octet_length("value") > 0)
