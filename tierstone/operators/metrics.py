"""Counters, percentiles, throughput and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTERS = ("get_hits", "get_misses", "sets_stored", "sets_rejected", "bytes_served", "bytes_stored")


def counters(replies: DataFrame, *by: str) -> DataFrame:
    """Sums of the counters; partial sums before any shuffle. A hit counts whatever its status; a refused store counts as rejected."""
    verb, reply = F.col("verb"), F.col("reply")
    stored, hit = reply == "STORED", reply == "VALUE"
    store = verb.isin("set", "add", "replace", "cas")
    total = lambda what, name: F.coalesce(F.sum(what), F.lit(0)).cast("long").alias(name)
    one = lambda cond: F.when(cond, 1).otherwise(0)
    return replies.groupBy(*by).agg(
        total(one(hit), "get_hits"),
        total(one((verb == "get") & ~hit), "get_misses"),
        total(one(store & stored), "sets_stored"),
        total(one(store & ~stored), "sets_rejected"),
        total(F.when(hit, F.col("bytes")).otherwise(0), "bytes_served"),
        total(F.when(store & stored, F.col("bytes")).otherwise(0), "bytes_stored"),
    )


def report(summed: DataFrame) -> DataFrame:
    """name and value lines of the statistics report."""
    lines = {"cmd_get": "get_hits + get_misses", "cmd_set": "sets_stored + sets_rejected"} | {c: c for c in COUNTERS}
    return summed.select(F.expr(f"stack({len(lines)}, {', '.join(f'{name!r}, {expr}' for name, expr in lines.items())}) AS (name, value)"))


def nearest_rank(rows: DataFrame, by: str, value: str, percents: tuple[float, ...]) -> DataFrame:
    """by, percent, value: the element at trunc(p / 100 * (n - 1)) of each group's sorted values.

    Equal values are counted first, so a window holds a group's distinct values, not its rows.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n_"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto_", F.sum("n_").over(upto)).withColumn("all_", F.sum("n_").over(Window.partitionBy(by)))
    each = ranked.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    at = F.floor(F.col("percent") / 100 * (F.col("all_") - 1))
    return each.where((F.col("upto_") > at) & (F.col("upto_") - F.col("n_") <= at)).select(by, "percent", F.col(value).alias("value"))


def throughput(rows: DataFrame, by: str, size: str, seconds: float) -> DataFrame:
    return rows.groupBy(by).agg((F.count("*") / F.lit(seconds)).alias("ops_per_s"), (F.sum(size) / F.lit(1048576.0) / F.lit(seconds)).alias("mib_per_s"), (F.sum(size) / F.lit(1048576.0) / F.lit(seconds) * 8 / 1024).alias("gib_per_s"))


def stalls(rows: DataFrame, by: str, at: str, timeout: int) -> DataFrame:
    """Rows that come timeout or more after the one before of the same connection."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(by).orderBy(at, "seq"))
    return rows.withColumn("gap", gap).where(F.col("gap") >= timeout)
