"""Secret scans with corpus-wide ownership frequency.

Three base patterns find secrets. Beyond them, every long mixed token that isn't made of words (paths, names of classes) is a
candidate: candidates' hashes are counted by distinct repositories and owners over the whole corpus, and those that stay with one owner are added, whereas
values that many owners share (documentation, licences, sample keys) are told apart as examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm.common import Scratch, broadcast_few, own_columns, table

#: Java patterns. `least`: characters that a match (assign: its group 2) needs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs of 24 or more: the same as maximal runs of which short ones are dropped
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: A candidate beyond the base patterns: a run of 20 or more with a digit, an upper- and a lower-case letter, of which less than
#: half are in runs of four or more letters of one case. In names and paths more than half are; 3.9 % of random tokens of 20 characters look so too, 1.5 % of 32.
CANDIDATE, WORDLIKE = r"[A-Za-z0-9+/_-]{20,}", "[a-z]{4,}|[A-Z]{4,}"
#: A value of so many owners, or of one owner's so many repositories, is an example.
MANY_OWNERS, MANY_REPOSITORIES = 3, 8
KINDS = ("assign", "access", "hex", "owned")


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """SQL: array of (start, end, kind order, value) of a pattern's matches, by code points. The text is split by the pattern; gaps and matches in turn give the places."""
    order = KINDS.index(kind)
    p = pattern.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')
    empty = "cast(array() AS array<struct<start:int,end:int,kind:int,value:string>>)"
    value = f"regexp_extract(get(m, i), '{p}', {group})" if group else "get(m, i)"
    step = (
        f"(a, i) -> struct(a.at + length(get(g, i)) + length(get(m, i)) AS at, "
        f"if(length({value}) >= {least}, concat(a.out, array(struct(a.at + length(get(g, i)) AS start, a.at + length(get(g, i)) + length(get(m, i)) AS end, {order} AS kind, {value} AS value))), a.out) AS out)"
    )
    inner = f"aggregate(sequence(0, size(m) - 1), struct(0 AS at, {empty} AS out), {step}, a -> a.out)"
    bound = f"element_at(transform(array(split(text, '{p}')), g -> {inner}), 1)"
    return f"element_at(transform(array(regexp_extract_all(text, '{p}', 0)), m -> if(size(m) = 0, {empty}, {bound})), 1)"


def scan(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    base = own_columns(docs, {"doc_id": id_col, "text": text_col, "repository": repository_col, "owner": owner_col} | {f"keep_{c}": c for c in keep})
    base = base.withColumn("text", F.coalesce("text", F.lit("")))
    found = [_spans("assign", ASSIGN, 1, ASSIGN_LEAST), _spans("access", ACCESS, 0, ACCESS_LEAST), _spans("hex", HEX, 0, 24)]
    mixed = f"x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Z]' AND x.value RLIKE '[a-z]' AND 2 * length(regexp_replace(x.value, '{WORDLIKE}', '')) > length(x.value)"
    owned = f"filter({_spans('owned', CANDIDATE, 0, 20)}, x -> {mixed})"
    return base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", *[f"keep_{c}" for c in keep], F.expr(f"concat({', '.join(found)})").alias("base"), F.expr(owned).alias("more")
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "repository", owner_col: str = "owner", many_owners: int = MANY_OWNERS, many_repositories: int = MANY_REPOSITORIES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and spans (start, end, kind, value_sha256, owners, repositories, example) for each row of docs.

    Base spans (kinds assign, access, hex; `start` and `end` of the whole match, in code points) always stay, whatever their
    frequency. Kind `owned` adds candidates of the same look that no base span touches and that are no examples. A null
    owner or repository counts as one of its own name. Null and empty texts have no spans. Repeated rows are scanned one by
    one. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    rows = scratch.save(_hashed(scan(docs, id_col, text_col, repository_col, owner_col)), "scanned")
    return _judged(rows, many_owners, many_repositories)


def _hashed(scanned: DataFrame) -> DataFrame:
    """Values leave the scan as hashes only, so that no secret is written anywhere."""
    one = "transform({0}, x -> struct(x.start AS start, x.end AS end, x.kind AS kind, sha2(x.value, 256) AS value))"
    apart = "filter(more, y -> NOT exists(base, x -> x.start < y.end AND y.start < x.end))"
    return scanned.withColumn("base", F.expr(f"array_sort({one.format('base')})")).withColumn("more", F.expr(one.format(apart)))


def ownership(rows: DataFrame) -> DataFrame:
    """value, owners, repositories: distinct ones for each candidate's hash. Rows are reduced to distinct (value, owner, repository) before the counts, so a value of a third of all rows costs no more than its owners do."""
    every = rows.select("owner", "repository", F.explode(F.concat("base.value", "more.value")).alias("value"))
    every = every.select("value", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("repository")).distinct()
    by_owner = every.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def _judged(rows: DataFrame, many_owners: int, many_repositories: int) -> DataFrame:
    spans = rows.select("row", "doc_id", F.explode_outer(F.concat("base", "more")).alias("x")).select("row", "doc_id", "x.start", "x.end", "x.kind", "x.value")
    spans = spans.where(F.col("value").isNotNull())
    judged = spans.join(ownership(rows), "value").withColumn("example", (F.col("owners") >= many_owners) | (F.col("repositories") >= many_repositories))
    judged = judged.where((F.col("kind") < KINDS.index("owned")) | ~F.col("example"))
    grouped = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repositories", "example"))).alias("spans"))
    none = F.array().cast(grouped.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(grouped, "row", "left").select("row", "doc_id", F.coalesce("spans", none).alias("spans"))


def _named(spans: str, where: str = "true") -> Column:
    kinds = ",".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(filter({spans}, x -> {where}), x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str = "source", mark: str = "<SECRET>") -> DataFrame:
    """docs, in their own columns, with base and owned spans replaced by mark; overlapping ones by one mark. Texts without spans and null texts are as before."""
    cols = docs.columns
    scratch = Scratch(docs.sparkSession, "redact")
    marked = scratch.save(docs.select("*", F.monotonically_increasing_id().alias("row__")), "docs")
    scanned = scan(marked, id_col, text_col, repository_col, owner_col, keep=("row__",))
    rows = scratch.save(_hashed(scanned.withColumn("row", F.col("keep_row__"))).where((F.size("base") > 0) | (F.size("more") > 0)), "scanned")
    spans = broadcast_few(scratch.save(_judged(rows, MANY_OWNERS, MANY_REPOSITORIES).select(F.col("row").alias("row__"), "spans"), "spans"))
    merged = (
        "aggregate(spans, cast(array() AS array<struct<start:int,end:int>>), (a, x) -> CASE"
        " WHEN size(a) > 0 AND element_at(a, -1).end > x.start THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, x.end) AS end)))"
        " ELSE concat(a, array(struct(x.start AS start, x.end AS end))) END)"
    )
    text = f"`{text_col}`"
    mark_sql = mark.replace("'", "\\'")
    rebuilt = (
        f"concat(concat_ws('', transform(m__, (x, i) -> concat(substring({text}, if(i = 0, 0, get(m__, i - 1).end) + 1, x.start - if(i = 0, 0, get(m__, i - 1).end)), '{mark_sql}'))),"
        f" substring({text}, element_at(m__, -1).end + 1))"
    )
    joined = marked.join(spans, "row__", "left").withColumn("m__", F.expr(merged))
    return joined.withColumn(text_col, F.when(F.coalesce(F.size("m__"), F.lit(0)) <= 0, F.col(text)).otherwise(F.expr(rebuilt))).select(*cols)


def op9_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repository"))
    found = find_secrets(docs)
    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = {KINDS.index(kind)})) AS bigint)")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_named("spans", f"x.kind < {KINDS.index('owned')}"), 256).alias("base_sha256"),
        _named("spans").alias("spans"),
        count("owned").alias("n_owned"),
        F.expr("cast(size(filter(spans, x -> x.example)) AS bigint)").alias("n_examples"),
    )


def _sql() -> str:
    kinds = [("assign", ASSIGN, 1, ASSIGN_LEAST), ("access", ACCESS, 0, ACCESS_LEAST), ("hex", HEX, 0, 24), ("owned", CANDIDATE, 0, 20)]
    union = " UNION ALL ".join(
        f"SELECT doc_id, owner, repository, {i} AS kind, start, start + length(x) AS stop, v FROM (SELECT *, regexp_extract(x, '{p}', {g}) AS v FROM (SELECT doc_id, owner, repository, m[i] AS x,"
        f" (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::INTEGER AS start FROM"
        f" (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM d)))) WHERE length(v) >= {least}"
        for i, (_, p, g, least) in enumerate((k, p.replace("'", "''"), g, n) for k, p, g, n in kinds)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
every AS ({union}),
base AS (SELECT * FROM every WHERE kind < 3),
more AS (SELECT * FROM every e WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND 2 * length(regexp_replace(v, '{WORDLIKE}', '', 'g')) > length(v) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)),
s AS (SELECT * FROM base UNION ALL SELECT * FROM more),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM s GROUP BY v),
j AS (SELECT s.*, (owners >= {MANY_OWNERS} OR repositories >= {MANY_REPOSITORIES}) AS example,
  ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS named FROM s JOIN o USING (v)),
k AS (SELECT * FROM j WHERE kind < 3 OR NOT example)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(named, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(named, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (example) AS n_examples
FROM (SELECT doc_id FROM documents) LEFT JOIN k USING (doc_id) GROUP BY doc_id
"""


OP9_SQL = _sql()
