"""Where an object's bytes are: tiers by position, stripes over drives, and rounded sizes. All is integer arithmetic in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.config import DEVICE_BLOCK, Tiers


def layout(size: Column, tiers: Tiers, three: bool) -> Column:
    """struct(head, ssd, hdd). An object that fits its head has nothing on disk."""
    small = size <= tiers.ram_head
    ssd = F.when(small, 0).otherwise(F.least(size, F.lit(tiers.ssd_prefix)) if three else size)
    hdd = F.when(small | F.lit(not three), 0).otherwise(F.greatest(size - tiers.ssd_prefix, F.lit(0)))
    return F.struct(F.least(size, F.lit(tiers.ram_head)).cast("long").alias("head"), ssd.cast("long").alias("ssd"), hdd.cast("long").alias("hdd"))


def place(offset: Column, ssd_bytes: Column) -> Column:
    on_ssd = offset < ssd_bytes
    return F.struct(F.when(on_ssd, "ssd").otherwise("hdd").alias("tier"), F.when(on_ssd, offset).otherwise(offset - ssd_bytes).alias("local"))


def is_power_of_two(v: Column) -> Column:
    return (v != 0) & (v.bitwiseAND(v - 1) == 0)


def align_up(v: Column, unit: int = DEVICE_BLOCK) -> Column:
    return (v + (unit - 1)).bitwiseAND(F.lit(-unit))


def align_down(v: Column, unit: int = DEVICE_BLOCK) -> Column:
    return v.bitwiseAND(F.lit(-unit))


def drive_of(bucket: Column, chunk: Column, drives: int) -> Column:
    """The first stripe's drive is rotated by the bucket; the sum wraps at 2^64."""
    return F.pmod(F.pmod(bucket.cast("decimal(21,0)") + chunk.cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(21,0)")), F.lit(drives).cast("decimal(21,0)")).cast("int")


def files_used(size: Column, stripe: int, drives: int) -> Column:
    return F.when(size > 0, F.least(F.lit(drives), F.ceil(size / F.lit(stripe)))).otherwise(0).cast("int")


def buddy_bytes(size: Column, arena: int, least: int = DEVICE_BLOCK) -> Column:
    """The block that a buddy allocator gives: the next power of two, `least` at least; null if nothing fits."""
    rounded = F.greatest(F.pow(F.lit(2), F.length(F.bin(size - 1))).cast("long"), F.lit(least))
    return F.when((size <= 0) | (rounded > arena), None).when(size == 1, F.lit(least)).otherwise(rounded).cast("long")


def plan_reads(reads: DataFrame, bucket: str, offset: str, length: str, stripe: int, drives: int) -> DataFrame:
    """One row for each stripe that a read touches, in order: chunk, drive, file_offset, length, and `at`, where it stands in the read. Empty reads touch none.

    The bucket, unsigned 64-bit, is reduced once a read: to its drive, and to how many stripes remain before the sum wraps. A
    stripe takes arithmetic on longs alone.
    """
    wide = F.col(bucket).cast("decimal(21,0)")
    left = F.least(F.lit(str(2**64)).cast("decimal(21,0)") - wide, F.lit(2**62).cast("decimal(21,0)"))
    kept = reads.where(F.col(length) > 0).withColumn("first_", F.pmod(wide, F.lit(drives).cast("decimal(21,0)")).cast("long")).withColumn("left_", left.cast("long"))
    chunks = kept.withColumn("chunk", F.explode(F.expr(f"sequence({offset} div {stripe}, ({offset} + {length} - 1) div {stripe})")))
    begin, end = F.greatest(F.col(offset), F.col("chunk") * stripe), F.least(F.col(offset) + F.col(length), (F.col("chunk") + 1) * stripe)
    drive = F.pmod(F.col("first_") + F.col("chunk") - F.when(F.col("chunk") >= F.col("left_"), F.lit(2**64 % drives)).otherwise(0), F.lit(drives).cast("long"))
    return chunks.select(
        *reads.columns,
        "chunk",
        drive.cast("int").alias("drive"),
        (F.expr(f"(chunk div {drives}) * {stripe}") + F.pmod(begin, F.lit(stripe))).alias("file_offset"),
        (end - begin).alias("seg_length"),
        (begin - F.col(offset)).alias("at"),
    )


def tier_parts(reads: DataFrame, offset: str, length: str, head: str, tiers: Tiers, three: bool = True) -> DataFrame:
    """One row for each tier that a read of an object touches: tier (ram, ssd, hdd), begin (in that tier's file; in the head for ram), part_length and `at`, where it stands in the read.

    head: bytes of the object that are resident, 0 if none. A read ends with the object (column size); one that starts behind it touches nothing.
    """
    places = layout(F.col("size"), tiers, three)
    rows = reads.withColumn("end_", F.least(F.col(offset) + F.col(length), F.col("size"))).withColumn("ssd_", places["ssd"]).withColumn("hdd_", places["hdd"])
    begin, end, ram, ssd = F.col(offset), F.col("end_"), F.col(head), F.col("ssd_")
    on_ssd, on_hdd = F.greatest(begin, ram), F.greatest(begin, ssd)
    part = lambda tier, at, size, file_at: F.struct(F.lit(tier).alias("tier"), file_at.alias("begin"), size.alias("part_length"), (at - begin).alias("at"))
    parts = F.array(
        part("ram", begin, F.least(end, ram) - begin, begin),
        part("ssd", on_ssd, F.least(end, ssd) - on_ssd, on_ssd),
        part("hdd", on_hdd, F.when(F.col("hdd_") > 0, end - on_hdd).otherwise(0), on_hdd - ssd),
    )
    each = rows.where((begin < F.col("size")) & (F.col(length) > 0)).withColumn("p", F.explode(F.filter(parts, lambda p: p["part_length"] > 0)))
    return each.select(*reads.columns, "p.*")


def value_pieces(begin: Column, end: Column, head: Column, chunk: int) -> Column:
    """Pieces in which the bytes of [begin, end) that are not in the head are sent."""
    return F.ceil(F.greatest(end - F.greatest(begin, head), F.lit(0)) / F.lit(chunk)).cast("long")


def flushed_bytes(size: Column, tiers: Tiers, three: bool = True) -> Column:
    """struct(ssd, hdd): bytes that a store writes to each tier. Only the tier that holds the tail is padded to whole device blocks."""
    places = layout(size, tiers, three)
    tail = places["hdd"] > 0
    return F.struct(F.when(tail, places["ssd"]).otherwise(align_up(places["ssd"])).alias("ssd"), F.when(tail, align_up(size) - places["ssd"]).otherwise(0).cast("long").alias("hdd"))
