"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams, one of target text and one of all raw text, give each document the log of the
ratio of its probabilities. Documents are sampled without replacement by Gumbel top-k on those weights. The raw model counts
every document; the target model counts labelled good ones, at most a documented number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm.common import Scratch, own_columns, table, tidy

#: Buckets of the hashed n-grams of each length (as a power of two), their greatest length, pseudo-counts that pull a bucket's
#: ratio to 1. Pairs (ORDER 2) cost three times the shuffle and told no more bad documents on the labelled tables.
BITS, ORDER, SMOOTH = 20, 1, 4.0
#: Standard deviations within which a bucket's ratio is taken for chance: the choices, of which held-out labels choose; SURE where
#: they can't, and the nearest to it of choices that tie.
SURES, SURE = (1.5, 2.0, 3.0, 4.0, 6.0), 4.0
#: Parts that the labels are dealt into by the hashes of their ids: part 0 sets the cut, the others fit, and choose among SURES by turns.
PARTS = 4
#: Labelled documents at most that choose among SURES, by the hashes of their ids.
MOST_TRIED = 100_000
#: Target documents at most, chosen by the hashes of their ids.
MOST_TARGETS = 50_000
#: Scale of the Gumbel noise in units of log weight: 1 samples in proportion to the weights, 0 takes the largest.
NOISE = 0.05
#: What losing a good document costs when the cut is set, against 1 for keeping a bad one.
LOSS = 10.0
#: Width of the bins in which a cut is sought, and how far they reach from 0.
STEP, REACH = 0.125, 256.0
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPACE = b" \t\n\r\x0b\x0c"
_ALNUM = bytes(i for i in range(256) if i >= 128 or chr(i).isalnum())
_BLANKED = bytes(i if i in _ALNUM or i in _SPACE else 32 for i in range(256))


def gram_buckets(text: bytes | None, bits: int = BITS, order: int = ORDER) -> np.ndarray:
    """Distinct buckets of a text's n-grams, up to `order` words each, A-Z lowered, and of the marks that stay of its tokens without letters and digits. Once a text, so that lines repeated within it don't count as evidence. n-grams of each length have buckets of their own."""
    text = (text or b"").lower()
    digest, shift = xxhash.xxh3_64_intdigest, np.uint64(64 - bits)
    h = np.array([digest(w) for w in text.translate(_BLANKED).split()], np.uint64)
    marks = np.array([digest(b"\0" + m) for m in set(text.translate(None, _ALNUM).split())], np.uint64)
    found = [(h * _A) >> shift, (marks * _A) >> shift]
    gram = h
    for n in range(2, order + 1):
        gram = gram[:-1] * _B + h[n - 1 :] * _C
        found.append(np.uint64((n - 1) << bits) + ((gram * _A) >> shift))
    return np.unique(np.concatenate(found)).astype(np.int64)


_TARGETS = [f"t{p}" for p in range(1, PARTS)]


def _counted(bits: int, order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(order << bits, np.int64), np.zeros((PARTS, order << bits), np.int32)
        for batch in batches:
            for text, part in zip(batch.column(0), batch.column(1), strict=True):
                got = gram_buckets(text.as_py(), bits, order)
                raw[got] += 1
                if part.as_py():
                    target[part.as_py(), got] += 1
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"bucket": part, "raw": raw[part]} | {t: target[p, part].astype(np.int64) for p, t in enumerate(_TARGETS, 1)})

    return count


def _scored(ratios, bits: int, order: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, values = ratios.value
        table_ = np.zeros(order << bits)
        table_[buckets] = values
        for batch in batches:
            n, weights = [], []
            for text in batch.column(batch.num_columns - 1):
                got = gram_buckets(text.as_py(), bits, order)
                n.append(len(got))
                weights.append(float(table_[got].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(weights, pa.float64())], [*batch.schema.names[:-1], "n_grams", "log_weight"])

    return score


def median_share(counts: DataFrame) -> float | None:
    """The median share of target text in raw text over target grams, within 0.05 % at any size: its logarithm is rounded, to keep distinct values few."""
    share = F.round(F.log(F.col("target") / F.col("raw")), 3)
    middle = counts.where("target > 0").agg(F.percentile(share, 0.5, F.col("target"))).first()[0]
    return None if middle is None else float(np.exp(middle))


def _tried(tables, bits: int, order: int, step: float, reach: float, smooth: float, sures: tuple[float, ...]):
    """Counts of labelled documents by part, good, choice and bin of the weight that the other parts' counts give. Ratios are made for a document's buckets, so a worker holds two counts a bucket and part and no table of each choice."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, raw, left, shares = tables.value
        at, found = np.full(order << bits, -1, np.int32), {}
        at[buckets] = np.arange(len(buckets))
        for batch in batches:
            for text, part, good in zip(*batch.columns, strict=True):
                got = at[gram_buckets(text.as_py(), bits, order)]
                got, p = got[got >= 0], part.as_py()
                counts, target = raw[got].astype(np.float64), left[p][got]
                weights = np.array([_ratios(counts, target, shares[p], smooth, s).sum() for s in sures])
                for choice, b in enumerate(np.floor(np.clip(weights, -reach, reach) / step).astype(int).tolist()):
                    key = (part.as_py(), good.as_py(), choice, b)
                    found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_pylist([{"part": p, "good": g, "choice": c, "b": b, "n": n} for (p, g, c, b), n in found.items()], pa.schema(dict(part=pa.int64(), good=pa.bool_(), choice=pa.int64(), b=pa.int64(), n=pa.int64())))

    return score


def _ratios(raw: np.ndarray, target: np.ndarray, share: float, smooth: float, sure: float) -> np.ndarray:
    """Ratios shrink to 0 as they come near what chance gives (`sure` standard deviations), or else copies of a text would look like evidence against it."""
    expected = raw * share
    z = np.abs(target - expected) / np.sqrt(expected + 1)
    return np.where(z > sure, (1 - (sure / np.maximum(z, sure)) ** 2) * np.log((target + smooth) / (expected + smooth)), 0.0)


def fit_ratios(docs: DataFrame, marks: DataFrame, scratch: Scratch, bits: int = BITS, order: int = ORDER, smooth: float = SMOOTH, sures: tuple[float, ...] = SURES, most_targets: int = MOST_TARGETS, most_tried: int = MOST_TRIED) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets whose log ratio is not 0, the ratios (two aligned arrays, at most order << bits long) and the choice among sures. docs: id, text; marks: distinct ids, good, part (1 to PARTS - 1).

    A bucket's expected count is its raw count times the median share of target text in raw text, over target grams: junk
    in the raw text, which has grams of its own, does not lift the ratio of ordinary ones. Each part's documents are tried with
    the ratios that the good ones of the other parts give; the choice that parts them at the least cost, on average, is used with all.
    """
    nearest = lambda rows, most: F.broadcast(rows.select(F.col("id").alias("t_id"), "good", F.col("part").alias("t_part")).orderBy(F.xxhash64("t_id"), "t_id").limit(most))
    text = F.col("text").cast("binary").alias("text")
    marked = docs.join(nearest(marks.where("good"), most_targets), F.col("id") == F.col("t_id"), "left").select(text, F.coalesce(F.col("t_part"), F.lit(0)).alias("part"))
    schema = ", ".join(f"{c} long" for c in ["bucket", "raw", *_TARGETS])
    counts = marked.mapInArrow(tidy(_counted(bits, order)), schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["raw", *_TARGETS]])
    counts = scratch.save(counts.withColumn("target", sum(map(F.col, _TARGETS))), "counts")
    share = median_share(counts)
    if share is None:
        return np.empty(0, np.int64), np.empty(0), SURE
    sums = counts.agg(*[F.sum(c) for c in _TARGETS]).first()
    rest = {p: 1 - n / sum(sums) for p, n in enumerate(sums, 1)}
    far = lambda target, share: F.abs(target - F.col("raw") * share) > min(sures) * F.sqrt(F.col("raw") * share + 1)
    some = far(F.col("target"), F.lit(share))
    for p, t in enumerate(_TARGETS, 1):
        some = some | far(F.col("target") - F.col(t), F.lit(share * rest[p]))
    rows = counts.where(some).orderBy("bucket").toArrow()
    scratch.drop(counts)
    buckets, raw, target = (rows.column(c).to_numpy() for c in ("bucket", "raw", "target"))
    by_part = {p: (target - rows.column(t).to_numpy()).astype(np.int32) for p, t in enumerate(_TARGETS, 1)}
    tables = docs.sparkSession.sparkContext.broadcast((buckets.astype(np.int32), raw, by_part, {p: share * rest[p] for p in by_part}))
    tried = docs.join(nearest(marks, most_tried), F.col("id") == F.col("t_id")).select(text, "t_part", "good")
    tried = tried.mapInArrow(tidy(_tried(tables, bits, order, STEP, REACH, smooth, sures)), "part long, good boolean, choice long, b long, n long").groupBy("part", "good", "choice", "b").agg(F.sum("n").alias("n")).collect()
    costs = []
    for choice, sure in enumerate(sures):
        each = [_best({r["b"]: r["n"] for r in tried if (r["part"], r["choice"]) == (p, choice) and r["good"]}, {r["b"]: r["n"] for r in tried if (r["part"], r["choice"]) == (p, choice) and not r["good"]}) for p in by_part]
        each = [found[0] for found in each if found]
        costs += [(round(sum(each) / len(each), 12), abs(sure - SURE), sure)] if each else []
    sure = min(costs)[2] if costs else SURE
    tables.unpersist()
    ratios = _ratios(raw, target, share, smooth, sure)
    return buckets[ratios != 0], ratios[ratios != 0], sure


def kth_largest(rows: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, exactly, by counts in ever finer bins; None if k is 0. No values but the last bin's few distinct ones are gathered."""
    low, high, n = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    if not k or low is None:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / bins
        inside = rows.where(F.col(col).between(low, high))
        at = F.least(F.floor((F.col(col) - low) / F.lit(width)), F.lit(bins - 1))
        got = {r["b"]: r for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()}
        for b in sorted(got, reverse=True):
            if got[b]["n"] >= k:
                low, high = got[b]["low"], got[b]["high"]
                break
            k -= got[b]["n"]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", noise: float = NOISE, seed: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept for each row of docs. key: log_weight plus Gumbel noise; kept: the k largest keys.

    Good: quality is not 0 and toxic is 0; null labels are none, contradicting ones make a document bad. Three in four labelled
    documents, by the hash of the id, fit the target model and choose how sure it has to be. Without k, k is the number of documents whose key reaches the
    cut that best parts the others. Without labels of both kinds, all are kept. Null and empty texts have weight 0.
    Repeated rows and equal ids get equal keys, and ties at the k-th key are all kept.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "importance")
    base = own_columns(docs, {"id": id_col, "text": text_col})
    marks = own_columns(labels, {"id": label_id_col, "q": quality_col, "t": toxic_col}).where("id IS NOT NULL AND q IS NOT NULL AND t IS NOT NULL")
    marks = marks.groupBy("id").agg(F.min((F.col("q") > 0) & (F.col("t") <= 0)).alias("good")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(PARTS)))
    buckets, values, _ = fit_ratios(base, marks.where("part > 0"), scratch)
    ratios = spark.sparkContext.broadcast((buckets, values))
    id_type = dict(base.dtypes)["id"]
    scored = base.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_scored(ratios, BITS, ORDER)), f"id {id_type}, n_grams long, log_weight double")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit("gumbel"), "id"), F.lit(2**52)) + F.lit(0.5)) / F.lit(2.0**52)
    scored = scratch.save(scored.withColumn("key", F.col("log_weight") - noise * F.log(-F.log(u))), "scored")
    cut = _cut(scored, marks) if k is None else kth_largest(scored, "key", k)
    kept = F.lit(k is None) if cut is None else F.col("key") >= cut
    return scored.select(F.col("id").alias("doc_id"), "n_grams", "log_weight", "key", kept.alias("kept"))


def _cut(scored: DataFrame, marks: DataFrame) -> float | None:
    """Of the held-out labelled documents' keys, counted in bins: the cut of least cost; the middle of the bins that tie."""
    held = scored.join(marks.where("part = 0"), "id").groupBy(F.floor(F.least(F.greatest("key", F.lit(-REACH)), F.lit(REACH)) / STEP).alias("b"), "good").count().collect()
    found = _best({r["b"]: r["count"] for r in held if r["good"]}, {r["b"]: r["count"] for r in held if not r["good"]})
    return found and found[1]


def _best(good: dict[int, int], bad: dict[int, int]) -> tuple[float, float] | None:
    """The least cost and its cut, by counts in bins; None without counts of both kinds."""
    if not good or not bad:
        return None
    n_good, n_bad = sum(good.values()), sum(bad.values())
    lost, stays, best = 0, n_bad, []
    for b in range(int(-REACH / STEP), int(REACH / STEP) + 1):  # the cut at the lower end of bin b
        best.append((LOSS * lost / n_good + stays / n_bad, b))
        lost, stays = lost + good.get(b, 0), stays - bad.get(b, 0)
    least = min(best)[0]
    ties = [b for cost, b in best if cost <= least + 1e-12]
    return least, ties[len(ties) // 2] * STEP


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
