"""Replays that need no state machine: windows over a key's commands, and numbers over the whole log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Log positions that are numbered in one window.
BLOCK = 1 << 16


def live_before(commands: DataFrame) -> DataFrame:
    """Adds live: whether the key was stored before each command, with no expiry and no tokens in the log."""
    sets = F.when(F.col("verb").isin("set", "add"), True).when(F.col("verb") == "delete", False)
    before = Window.partitionBy("digest").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return commands.withColumn("live", F.coalesce(F.last(sets, ignorenulls=True).over(before), F.lit(False)))


def stores(live: Column) -> Column:
    verb = F.col("verb")
    return (verb == "set") | ((verb == "add") & ~live) | ((verb == "replace") & live)


def reply(live: Column) -> Column:
    verb = F.col("verb")
    return F.when(verb == "delete", F.when(live, "DELETED").otherwise("NOT_FOUND")).when(verb == "get", F.when(live, "VALUE").otherwise("END")).otherwise(F.when(stores(live), "STORED").otherwise("NOT_STORED"))


def numbered(rows: DataFrame, counts: Column, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the running count, over the whole log, of rows for which `counts` holds; null for the others.

    Rows are numbered inside blocks of the order, in parallel; one line a block meets in a single task to give the blocks' offsets.
    """
    marked = rows.withColumn("block_", F.floor(F.col(order) / F.lit(block))).withColumn("one_", F.when(counts, 1).otherwise(0).cast("long"))
    totals = marked.groupBy("block_").agg(F.sum("one_").alias("n_"))
    offsets = totals.select("block_", (F.sum("n_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).alias("offset_"))
    inside = Window.partitionBy("block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.withColumn("run_", F.sum("one_").over(inside)).join(offsets, "block_")
    return out.withColumn(name, F.when(F.col("one_") == 1, F.col("run_") + F.col("offset_"))).drop("block_", "one_", "run_", "offset_")


def previous_version(stored: DataFrame, order: str = "seq") -> DataFrame:
    return stored.withColumn("previous", F.lag(order).over(Window.partitionBy("digest").orderBy(order)))


def final_state(replies: DataFrame) -> DataFrame:
    """The state after each key's last command, for keys that are present then."""
    last = replies.groupBy("digest").agg(F.max_by(F.struct("present", "size", "flags", "expiry", "etag"), "seq").alias("s"))
    return last.where("s.present").select("digest", "s.size", "s.flags", "s.expiry", "s.etag")
