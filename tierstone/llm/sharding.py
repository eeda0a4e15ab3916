"""Shards by sampled splitters.

A size-weighted sample of the keys gives quantile boundaries; records are range-partitioned between them, and a range that
turns out overfull is sampled and cut again. Only the sample, bounded by a parameter, and one line of counts a range reach the
driver. A record's shard and slot follow from the exact bytes and rows before it, which need a window inside its range alone.

Keys are (md5 of the text, id, row number of the scratch table): equal texts stand together, a group of copies that outgrows
its share is cut at an id, and repeated rows (same id, same text) at the row number.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierstone.llm.common import Scratch, own_columns, table

#: Keys drawn for each range that is cut; the first cut gives LEAST to MOST ranges, of about ROWS_A_RANGE rows.
DRAW, LEAST, MOST, ROWS_A_RANGE = 16, 128, 4096, 1_000_000
#: A range is overfull beyond so many times its share of bytes or rows; rounds of cutting.
OVERFULL, ROUNDS = 3.0, 8
NO_ID = -(2**63) + 1


def _draw(rows: DataFrame, n: int) -> list[tuple[str, int, int]]:
    """n keys, drawn without replacement and in proportion to size: of exponential clocks with the size as rate, the first n."""
    u = (F.pmod(F.xxhash64(F.lit("draw"), "k", "id", "row"), F.lit(2**52)) + 1) / F.lit(2.0**52 + 2)
    drawn = rows.select("k", "id", "row", (-F.log(u) / F.col("size")).alias("clock")).orderBy("clock").limit(n)
    return sorted((r["k"], r["id"], r["row"]) for r in drawn.collect())


def _quantiles(keys: list, parts: int) -> list:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _range_of(splitters: list) -> Column:
    """How many splitters are at or below the row's key: a search over the heads of blocks, then in one block."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]

    def literal(keys: list) -> str:
        return "array(" + ",".join(f"named_struct('k','{k}','id',{i}L,'row',{r}L)" for k, i, r in keys) + ")"

    key = "named_struct('k',k,'id',id,'row',row)"
    head = f"size(filter({literal([b[0] for b in blocks])}, s -> s <= {key}))"
    inside = f"size(filter(element_at(array({','.join(map(literal, blocks))}), h), s -> s <= {key}))"
    return F.expr(f"element_at(transform(array({head}), h -> if(h = 0, 0, (h - 1) * {step} + {inside})), 1)")


def assign_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", law: str = "bytes", seed_parts: int | None = None) -> DataFrame:
    """id_col, size, text_crc32, shard, slot for each row of df.

    law `bytes`: shards of near-equal bytes; `rows`: row counts at most one apart. Size is the text's UTF-8 bytes plus 1; a null
    text has size 1 and the checksum of an empty one. Null ids sort first. Repeated rows get slots of their own. An empty
    table gives no rows. Other columns of df are not looked at.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law {law!r} is neither bytes nor rows")
    scratch = Scratch(df.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.save(
        own_columns(df, {"doc_id": id_col, "text": text_col}).select(
            "doc_id",
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
            F.md5(text.cast("binary")).alias("k"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = seed_parts or min(MOST, max(LEAST, n // ROWS_A_RANGE, n_shards))
    splitters = _quantiles(_draw(rows, DRAW * parts), parts)
    for _ in range(ROUNDS):
        counts = rows.groupBy(_range_of(splitters).alias("range")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
        over = {r["range"]: max(r["rows"] * parts / n, r["bytes"] * parts / total) for r in counts if r["rows"] > 1 and max(r["rows"] * parts / n, r["bytes"] * parts / total) > OVERFULL}
        if not over:
            break
        cut = {r: max(2, min(parts, round(x))) for r, x in over.items()}
        inside = rows.withColumn("range", _range_of(splitters)).where(F.col("range").isin(list(cut)))
        drawn = _draw(inside, min(DRAW * MOST, DRAW * sum(cut.values())))
        more = _cut_inside(splitters, drawn, cut)
        if not more - set(splitters):
            break
        splitters = sorted(set(splitters) | more)
    before_rows, before_bytes, at, sofar = [], [], 0, 0
    by = {r["range"]: r for r in rows.groupBy(_range_of(splitters).alias("range")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()}
    for r in range(len(splitters) + 1):
        before_rows.append(at)
        before_bytes.append(sofar)
        if r in by:
            at, sofar = at + by[r]["rows"], sofar + by[r]["bytes"]
    offset = lambda values: F.element_at(F.expr(f"array({','.join(f'{v}L' for v in values)})"), F.col("range") + 1)
    inside = Window.partitionBy("range").orderBy("k", "id", "row")
    placed = rows.withColumn("range", _range_of(splitters)).select(
        "doc_id",
        "size",
        "text_crc32",
        (offset(before_rows) + F.row_number().over(inside) - 1).alias("pos"),
        (offset(before_bytes) + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
    )
    shard = F.floor(F.col("pos") * n_shards / F.lit(max(n, 1))) if law == "rows" else F.expr(f"(2 * before + size) * {n_shards}L div {2 * max(total, 1)}L")
    placed = scratch.save(placed.select("doc_id", "size", "text_crc32", "pos", F.least(shard, F.lit(n_shards - 1)).cast("int").alias("shard")), "placed")
    held = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    scratch.drop(rows)
    starts, at = [], 0
    for s in range(n_shards):
        starts.append(at)
        at += held.get(s, 0)
    start = F.element_at(F.expr(f"array({','.join(f'{v}L' for v in starts)})"), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("pos") - start).alias("slot"))


def _cut_inside(splitters: list, drawn: list, cut: dict[int, int]) -> set:
    by: dict[int, list] = {}
    for key in drawn:
        by.setdefault(bisect_right(splitters, key), []).append(key)
    return {x for r, keys in by.items() for x in _quantiles(keys, cut.get(r, 1))}


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = assign_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP6_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS t
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS k, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents
), c AS (
  SELECT doc_id, k, size, xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, crc
), o AS (
  SELECT *, row_number() OVER w - 1 AS pos, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)
), s AS (SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
