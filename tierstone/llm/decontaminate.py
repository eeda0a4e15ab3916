"""Benchmark decontamination with a broadcast set of the benchmark's word n-grams.

Items and documents are reduced to lower-cased words. A document's windows are hashed. A table of FILTER bytes, a byte a bucket of
hashes, lets those through, inside the row, whose bucket has a window of the benchmark; they are looked up in the broadcast set of
the benchmark's hashes, and what is found there is verified by its words. Only then is anything shuffled. A set of more than MAX_SET
hashes is broadcast in parts, each of which scans the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm.common import Scratch, ascii_lower, let, own_columns, split_words, table

#: Separators of words: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Buckets of the table that every task carries, hashes of a broadcast set (some 60 bytes each), and windows, with their words and
#: items, that may be broadcast to verify hits. Beyond the last, Spark plans the verifying join by size.
FILTER, MAX_SET, MAX_BROADCAST = 1 << 18, 2_000_000, 200_000


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _windows(w: str, length: int) -> str:
    """SQL for the start positions of a word array's windows."""
    return f"if(size({w}) >= {length}, sequence(1, size({w}) - {length} + 1), cast(array() AS array<int>))"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each distinct window: gram (its words), len, items (the ids, as strings, of the items that have it)."""
    items = own_columns(benchmark, {"item": item_col, "text": text_col}).select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("w"))
    whole = items.where((F.size("w") > 0) & (F.size("w") < window)).select("item", F.array_join("w", " ").alias("gram"), F.size("w").alias("len"))
    cut = items.where(F.size("w") >= window).select("item", F.explode(F.expr(f"transform({_windows('w', window)}, i -> array_join(slice(w, i, {window}), ' '))")).alias("gram"), F.lit(window).alias("len"))
    return whole.unionByName(cut).groupBy("gram", "len").agg(F.collect_set("item").alias("items"))


def _passing(lengths: list[int], table_: Column, bucket: Callable[[Column], Column]) -> Column:
    """Array of (pos, len, h) of those windows of the word array w whose bucket is marked in the table."""
    if not lengths:
        return F.expr("cast(array() AS array<struct<pos:int,len:int,h:bigint>>)")
    hashed = lambda v, i, n: F.xxhash64(F.slice(v, i, n), n)
    marked = lambda h: F.substring(table_, (bucket(h) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")

    def of_length(v: Column, n: Column) -> Column:
        starts = F.when(F.size(v) >= n, F.sequence(F.lit(1), F.size(v) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, lambda i: marked(hashed(v, i, n))), lambda i: F.struct(i.alias("pos"), n.alias("len"), hashed(v, i, n).alias("h")))

    # let: the word array is bound to a lambda's variable, lest it be split anew for each window
    return let(F.col("w"), lambda v: F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: of_length(v, n))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids, as strings), spans (word positions [start, end), merged) for each row of docs.

    keep: columns of docs to carry, as keep_<name>. A word inside any occurrence of a window is hit. Null and empty texts have no
    words. Items without an id hit but are not listed; without words they do nothing. Repeated rows are judged one by one.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    # the number of words is hashed too, so that one set serves all lengths
    grams = scratch.save(benchmark_windows(benchmark, item_col, item_text_col, window).withColumn("h", F.expr("xxhash64(split(gram, ' '), len)")), "grams")
    bucket = lambda h: F.pmod(h, F.lit(FILTER))
    n_grams, lengths, buckets = grams.agg(F.count("*"), F.collect_set("len"), F.collect_set(bucket(F.col("h")))).first()  # window lengths and FILTER buckets at most
    table_ = bytearray(FILTER)
    for b in buckets:
        table_[b] = 1
    base = own_columns(docs, {"doc_id": id_col, "text": text_col} | {f"keep_{c}": c for c in keep})
    kept = [f"keep_{c}" for c in keep]
    base = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", *kept, words(F.col("text")).alias("w"))
    parts = max(1, -(-n_grams // MAX_SET))
    if parts > 1:
        base = scratch.save(base, "words")  # every scan has to see the same rows
    found = _passing(sorted(lengths), F.lit(bytes(table_)), bucket)
    # position 0 stands for the document itself and stays, whatever is found
    own = F.expr("array(struct(0 AS pos, 0 AS len, cast(null AS bigint) AS h))")
    verified = None
    for part in range(parts):
        at = F.concat(own, found) if part == 0 else found
        scanned = base.select("row", "doc_id", *kept, "w", F.explode(at).alias("at")).select("row", "doc_id", *kept, "w", "at.pos", "at.len", "at.h")
        hashes = grams.where(F.pmod("h", F.lit(parts)) == part).select(F.col("h").alias("g_h")).distinct()
        seen = scanned.join(F.broadcast(hashes), F.col("h") == F.col("g_h"), "left").where("pos = 0 OR g_h IS NOT NULL")
        itself = F.col("pos") == 0
        seen = seen.select(
            "row",
            *[F.when(itself, F.col(c)).alias(c) for c in ("doc_id", *kept)],
            F.when(itself, F.size("w").cast("long")).alias("n_words"),
            "pos",
            "len",
            F.expr("CASE WHEN pos > 0 THEN array_join(slice(w, pos, len), ' ') END").alias("gram"),
        )
        verified = seen if verified is None else verified.unionByName(seen)
    right = grams.select(F.col("gram").alias("g_gram"), F.col("len").alias("g_len"), "items")
    if n_grams <= MAX_BROADCAST:
        right = F.broadcast(right)
    hit = F.col("items").isNotNull()
    verified = verified.join(right, (F.col("gram") == F.col("g_gram")) & (F.col("len") == F.col("g_len")), "left").select(
        "row", "doc_id", *kept, "n_words", F.when(hit, F.struct("pos", "len")).alias("at"), "items"
    )
    by = verified.groupBy("row").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "n_words", *kept)],
        F.array_sort(F.collect_set("at")).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # merged spans: the positions are sorted, so each either lengthens the last span or starts one
    start = "x.pos - 1"
    end = "x.pos - 1 + x.len"
    merge = (
        "aggregate(at, cast(array() AS array<struct<start:int,end:int>>), (a, x) -> CASE"
        f" WHEN size(a) > 0 AND element_at(a, -1).end >= {start} THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, {end}) AS end)))"
        f" ELSE concat(a, array(struct({start} AS start, {end} AS end))) END)"
    )
    return by.select(
        "doc_id",
        "n_words",
        F.expr(merge).alias("spans"),
        "items",
        *kept,
    ).select(
        "doc_id",
        "n_words",
        F.expr("cast(aggregate(spans, 0, (a, s) -> a + s.end - s.start) AS bigint)").alias("n_hit"),
        "items",
        "spans",
        *kept,
    )


def is_contaminated(min_share_inverse: int = 20) -> Column:
    """By the columns of find_contamination: hit words are at least one in min_share_inverse."""
    return (F.col("n_hit") > 0) & (min_share_inverse * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without what the benchmark contaminates, in docs' own columns.

    mode `documents`: contaminated documents go. `spans`: every document stays, and the hit words go together with the
    separators between them; other separators stay. A document that has nothing left keeps an empty text; null stays null.
    """
    cols = docs.columns
    found = find_contamination(docs, benchmark, id_col, text_col, item_col, item_text_col, keep=tuple(cols))
    back = lambda text: [(text if c == text_col else F.col(f"`keep_{c}`")).alias(c) for c in cols]
    own = F.col(f"`keep_{text_col}`")
    if mode == "documents":
        return found.where(~is_contaminated()).select(*back(own))
    if mode != "spans":
        raise ValueError(f"mode {mode!r} is neither documents nor spans")
    # separators and words in turn, found in the text itself, so that their case stays
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    cut = found.withColumn("gaps", F.split(own, word)).withColumn("words", F.regexp_extract_all(own, F.lit(word), F.lit(0)))
    gone = "exists(spans, s -> s.start <= i AND i < s.end)"
    between = "exists(spans, s -> s.start < i AND i < s.end)"
    text = F.expr(f"concat_ws('', transform(sequence(0, size(words)), i -> concat(if({between}, '', get(gaps, i)), if(i >= size(words) OR {gone}, '', get(words, i)))))")
    return cut.select(*back(F.when(F.size("spans") == 0, own).otherwise(text)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []::VARCHAR[]) AS w FROM documents
), bw AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), g AS (
  SELECT item, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram, least(len(w), 13) AS len FROM bw WHERE len(w) > 0
), p AS (
  SELECT doc_id, n.len, unnest(range(1, len(w) - n.len + 2)) AS pos, w FROM dw, (SELECT DISTINCT len FROM g) n WHERE len(w) >= n.len
), h AS (
  SELECT DISTINCT p.doc_id, p.pos, p.len, g.item FROM (SELECT doc_id, pos, len, array_to_string(w[pos:pos + len - 1], ' ') AS gram FROM p) p JOIN g ON p.gram = g.gram AND p.len = g.len
), nh AS (
  SELECT doc_id, count(DISTINCT hit)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + len)) AS hit FROM h) GROUP BY doc_id
), ni AS (
  SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
