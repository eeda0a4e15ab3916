"""Queries of tiers, chunks, tenants and replies to lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierstone.functions import placement, protocol, sql
from tierstone.functions.identity import bucket
from tierstone.operators import catalog, chunks, replay, tenants
from tierstone.plans import views as V
from tierstone.plans.registry import _BIG_LAYOUT, _HOST, _TWO, BIG_TIERS, DRIVES, NOW, STRIPE, query

_LINES = """CASE seq % 12 WHEN 0 THEN 'get ' || key WHEN 1 THEN 'mg ' || key || ' v' WHEN 2 THEN 'mg ' || key || ' Z' WHEN 3 THEN 'mn' WHEN 4 THEN 'stats' WHEN 5 THEN 'incr ' || key || ' 1'
 WHEN 6 THEN 'mgx ' || key WHEN 7 THEN 'set ' || key || ' 1 1' WHEN 8 THEN 'md' WHEN 9 THEN '' WHEN 10 THEN 'ms ' || key || ' abc' ELSE 'version' END"""


@query(
    f"""WITH {V.CMD} SELECT seq, CASE WHEN seq % 12 IN (2, 8, 10) THEN 'CLIENT_ERROR bad meta command' WHEN seq % 12 = 3 THEN 'MN' WHEN seq % 12 IN (5, 6, 7, 9) THEN 'ERROR' END AS reply,
  CASE WHEN seq % 12 NOT IN (0, 11) THEN 'ERROR' END AS blocking_reply FROM cmd"""
)
def q49_refused_lines(spark, d):
    lines = V.commands(spark, d).select("seq", F.expr(_LINES).alias("line"))
    return lines.select("seq", protocol.refusal(F.col("line")).alias("reply"), protocol.refusal(F.col("line"), blocking=True).alias("blocking_reply"))


@query(f"WITH {V.CMD} SELECT seq, 2::BIGINT AS n_lines, seq % 3 = 0 AS dropped, CASE WHEN seq % 3 = 0 THEN 8193 ELSE 8192 END::BIGINT AS waiting, 'get ' || key AS first_line, '' AS second_line FROM cmd")
def q50_split_lines(spark, d):
    blob = F.expr("concat('get ', key, '\\r\\n\\r\\n', repeat('x', if(seq % 3 = 0, 8193, 8192)))")
    rows = V.commands(spark, d).select("seq", protocol.split_lines(blob).alias("s"))
    return rows.select("seq", F.size("s.lines").cast("long").alias("n_lines"), "s.dropped", F.octet_length("s.rest").cast("long").alias("waiting"), F.col("s.lines")[0].alias("first_line"), F.col("s.lines")[1].alias("second_line"))


_READS = f"""{V.BIG}, r AS (SELECT key, bucket, size, size // 3 AS off, size // 2 AS len, CASE WHEN right(key, 1) = '1' THEN 0 ELSE least(size, {BIG_TIERS.ram_head}) END AS resident, {_BIG_LAYOUT} FROM big),
e AS (SELECT *, least(off + len, size) AS stop FROM r WHERE off < size AND len > 0),
p AS (SELECT key, bucket, 'ram' AS tier, off AS "begin", least(stop, resident) - off AS part_length, 0::BIGINT AS "at" FROM e WHERE off < least(stop, resident)
  UNION ALL SELECT key, bucket, 'ssd', greatest(off, resident), least(stop, ssd) - greatest(off, resident), greatest(off, resident) - off FROM e WHERE greatest(off, resident) < least(stop, ssd)
  UNION ALL SELECT key, bucket, 'hdd', greatest(off, ssd) - ssd, stop - greatest(off, ssd), greatest(off, ssd) - off FROM e WHERE hdd > 0 AND stop > ssd)"""


def _parts(spark, d):
    resident = F.when(F.col("key").endswith("1"), F.lit(0)).otherwise(F.least("size", F.lit(BIG_TIERS.ram_head))).cast("long")
    reads = V.large(spark, d).select("key", "bucket", "size", F.expr("size div 3").alias("off"), F.expr("size div 2").alias("len"), resident.alias("resident"))
    return placement.tier_parts(reads, "off", "len", "resident", BIG_TIERS)


@query(f'WITH {_READS} SELECT key, tier, "begin", part_length, "at" FROM p')
def q51_tier_parts(spark, d):
    return _parts(spark, d).select("key", "tier", "begin", "part_length", "at")


@query(
    f"""WITH {_READS}, c AS (SELECT *, unnest(range("begin" // {STRIPE}, ("begin" + part_length - 1) // {STRIPE} + 1)) AS chunk FROM p WHERE tier <> 'ram')
SELECT tier, (((bucket::HUGEINT + chunk) % 18446744073709551616) % {DRIVES})::INTEGER AS drive, count(*) AS segments, sum(least("begin" + part_length, (chunk + 1) * {STRIPE}) - greatest("begin", chunk * {STRIPE}))::BIGINT AS total FROM c GROUP BY ALL"""
)
def q52_tiered_segments(spark, d):
    parts = _parts(spark, d).where("tier <> 'ram'").select("tier", "bucket", F.col("begin").alias("b"), F.col("part_length").alias("n"))
    return placement.plan_reads(parts, "bucket", "b", "n", STRIPE, DRIVES).groupBy("tier", "drive").agg(F.count("*").alias("segments"), F.sum("seg_length").alias("total"))


@query(f"WITH {_READS} SELECT key, len(range(greatest(off, resident), stop, {STRIPE}))::BIGINT AS pieces FROM e")
def q53_value_pieces(spark, d):
    resident = F.when(F.col("key").endswith("1"), F.lit(0)).otherwise(F.least("size", F.lit(BIG_TIERS.ram_head)))
    rows = V.large(spark, d).withColumn("off", F.expr("size div 3")).withColumn("len", F.expr("size div 2")).where("off < size AND len > 0")
    return rows.select("key", placement.value_pieces(F.col("off"), F.least(F.col("off") + F.col("len"), F.col("size")), resident, STRIPE).alias("pieces"))


# the SQL writes block by block, as a store does; the query has the sums in closed form
_FLUSH = f"""{V.BIG}, l AS (SELECT key, size, {_BIG_LAYOUT} FROM big), w AS (SELECT *, CASE WHEN hdd > 0 THEN ssd ELSE (ssd + 4095) // 4096 * 4096 END AS extent, unnest(range(0, size, {8 * STRIPE})) AS o FROM l WHERE ssd > 0),
n AS (SELECT *, least({8 * STRIPE}, (size - o + 4095) // 4096 * 4096) AS n FROM w)"""


@query(f"WITH {_FLUSH} SELECT key, sum(greatest(least(o + n, extent) - o, 0))::BIGINT AS ssd, sum(CASE WHEN hdd > 0 AND o + n > ssd THEN o + n - greatest(o, ssd) ELSE 0 END)::BIGINT AS hdd FROM n GROUP BY key")
def q54_flushed_bytes(spark, d):
    rows = V.large(spark, d).where(F.col("size") > BIG_TIERS.ram_head)
    return rows.select("key", placement.flushed_bytes(F.col("size"), BIG_TIERS).alias("f")).select("key", "f.*").groupBy("key").agg(F.sum("ssd").alias("ssd"), F.sum("hdd").alias("hdd"))


_TENANTS = f"""{V.REQ}, q AS (SELECT id, host, {_HOST} AS own FROM req), k AS (SELECT DISTINCT own AS name FROM q WHERE own <> '' AND length(own) % 4 <> 0),
s AS (SELECT *, CASE abs(id) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other.test' ELSE upper(own) END AS sni FROM q)"""


def _tenants(spark, d):
    from tierstone.functions.http import normalize_host

    rows = V.requests(spark, d).withColumn("own", normalize_host(F.col("host")))
    known = rows.where("own <> '' AND length(own) % 4 <> 0").select(F.col("own").alias("host"), F.concat(F.lit("cert:"), "own").alias("certificate")).distinct()
    return rows.withColumn("sni", F.expr("CASE abs(id) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other.test' ELSE upper(own) END")), known


@query(f"WITH {_TENANTS} SELECT id, sni, 'cert:' || name AS certificate FROM s LEFT JOIN k ON lower(sni) = name")
def q55_certificates(spark, d):
    rows, known = _tenants(spark, d)
    return tenants.select_certificate(rows.select("id", "sni"), known)


@query(f"WITH {_TENANTS} SELECT id, coalesce(sni, '') = '' OR own = lower(sni) AS host_ok FROM s")
def q56_misdirected(spark, d):
    return tenants.misdirected(_tenants(spark, d)[0]).select("id", "host_ok")


@query(f"{_TWO}, t AS (SELECT digest, max(seq) AS seq FROM probe GROUP BY 1) SELECT key, CASE WHEN t.seq IS NULL THEN expiry ELSE {NOW} + t.seq END AS expiry, coalesce(t.seq, -1) AS head FROM obj LEFT JOIN t USING (digest)")
def q57_touch_and_head(spark, d):
    last = V.probes(spark, d).groupBy("digest").agg(F.max("seq").alias("seq"))
    objects = V.objects(spark, d).select("digest", "key", "expiry", F.lit(-1).cast("long").alias("head"))
    touched = catalog.touch(objects, last.select("digest", (F.col("seq") + NOW).alias("new_expiry")))
    return catalog.set_head(touched, last.select("digest", F.col("seq").alias("new_head"))).select("key", "expiry", "head")


@query(f"{_TWO} SELECT p.seq, CASE WHEN o.digest IS NULL THEN 'absent' WHEN o.expiry = 0 OR o.expiry > {NOW} THEN 'hit' ELSE 'expired' END AS outcome FROM probe p LEFT JOIN obj o USING (digest)")
def q58_get_outcomes(spark, d):
    return catalog.classify_gets(V.probes(spark, d).select("seq", "digest"), V.objects(spark, d), NOW).select("seq", "outcome")


@query(f"WITH {V.CMD} SELECT seq, digest || '.tmp.' || (row_number() OVER (ORDER BY seq) - 1) AS scratch FROM cmd WHERE verb IN ('set', 'add', 'replace')")
def q59_scratch_names(spark, d):
    stores = V.commands(spark, d).where(F.col("verb").isin("set", "add", "replace"))
    return replay.numbered(stores, F.lit(True), "seq", "n").select("seq", F.concat("digest", F.lit(".tmp."), (F.col("n") - 1).cast("string")).alias("scratch"))


_CUT = 512


@query(f"WITH {V.OBJ}, t AS (SELECT digest, key, size // 3 AS off, size // 2 + 700 AS len FROM obj) SELECT key, lower(hex(encode(text))[2 * off + 1:2 * (off + len)]) AS body FROM t JOIN obj USING (digest, key) JOIN (SELECT doc_id, text FROM documents WHERE text <> '') USING (doc_id)")
def q60_gathered_ranges(spark, d):
    objects = V.objects(spark, d)
    texts = V.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("value"))
    values = objects.select("doc_id", "digest", bucket(F.col("digest")).alias("bucket")).join(texts, "doc_id")
    reads = objects.select(F.col("key").alias("read"), "digest", F.expr("size div 3").alias("off"), F.expr("size div 2 + 700").alias("len"))
    return chunks.gather(chunks.to_chunks(values, _CUT, DRIVES), reads, _CUT).select(F.col("read").alias("key"), F.lower(F.hex("value")).alias("body"))


@query(f"WITH {V.CMD} SELECT seq, coalesce(({list(protocol.ERRORS)})[seq % 15 + 1], 'unknown') AS name FROM cmd")
def q61_error_names(spark, d):
    return V.commands(spark, d).select("seq", protocol.error_name(F.expr("int(seq % 15)")).alias("name"))


@query(
    f"""WITH {V.OBJ} SELECT key, digest, ('0x' || substr(digest, 1, 2))::INTEGER AS shard, '"' || lower(to_base(size, 16)) || '-' || lower(to_base(etag, 16)) || '"' AS tag, (size + 4095) // 4096 * 4096 AS on_disk, CASE WHEN flags = 0 THEN 0 ELSE {NOW} + flags END AS expires, expiry = 0 OR expiry > {NOW} AS live FROM obj"""
)
def q62_sql_functions(spark, d):
    sql.register(spark)
    rows = V.objects(spark, d).select("key", "size", "etag", "flags", "expiry")
    return rows.selectExpr("key", "object_digest(key) AS digest", "object_shard(object_digest(key)) AS shard", "object_etag(size, etag) AS tag", "align_up(size) AS on_disk", f"expiry_of(flags, {NOW}) AS expires", f"is_live(expiry, {NOW}) AS live")
