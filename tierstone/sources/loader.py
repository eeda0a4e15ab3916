"""Bulk load of directory trees, and the guard of folders that the engine may overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.functions.http import KeyOptions, derive_key_from_relpath
from tierstone.functions.identity import digest

MARKER = ".tierstone-pool"


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of empty files, which the binaryFile reader leaves out."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def load_trees(spark: SparkSession, roots: list[str], options: KeyOptions = KeyOptions()) -> DataFrame:
    """digest, key, size, flags, expiry, value of every regular file; of equal keys, that of the last root. Files without a key are left out."""
    frames = []
    for i, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("content").alias("value"))
        if empty := _empty_files(spark, root):
            files = files.unionByName(spark.createDataFrame([(p, b"") for p in empty], "path string, value binary"))
        base = spark._jvm.org.apache.hadoop.fs.Path(root)
        base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
        relative = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
        frames.append(files.select(derive_key_from_relpath(relative, options).alias("key"), "value", F.lit(i).alias("root")))
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    kept = every.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by("value", "root").alias("value"))
    return kept.select(digest(F.col("key")).alias("digest"), "key", F.octet_length("value").cast("long").alias("size"), F.lit(0).cast("long").alias("flags"), F.lit(0).cast("long").alias("expiry"), "value")


class UnmarkedFolder(ValueError):
    """A folder that holds something and was never given to the engine."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def has_marker(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, MARKER))


def bless_folder(spark: SparkSession, path: str) -> None:
    """Marks a new or empty folder as the engine's; one that holds other things is refused."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and fs.listStatus(p) and not has_marker(spark, path):
        raise UnmarkedFolder(path)
    fs.mkdirs(p)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(p, MARKER), True).close()


def wipe_folder(spark: SparkSession, path: str) -> int:
    """Empties a marked folder, but for the mark, and returns how many entries went."""
    if not has_marker(spark, path):
        raise UnmarkedFolder(path)
    fs, p = _fs(spark, path)
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() != MARKER]
    for entry in gone:
        fs.delete(entry, True)
    return len(gone)
