"""The command state machine over a stream: keyed state, replies as they come, batch and stream alike."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.operators.machine import COMMAND, REPLY

STATE = "size long, flags long, expiry long, etag long"
#: Commands in a file of a log, and of those of one key as many as are packed in one array.
FILE_ROWS, PART = 1 << 19, 1 << 13
#: Bytes of a row group of a log, and the least that a task reads: several tasks share a file, which is all that a batch reads.
GROUP_BYTES = 1 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_processors: dict[str, object] = {}


def _processor(spark: SparkSession):
    """The state machine in Java (Commands.java), compiled once for an application by the compiler that Spark brings along, and handed to the executors in a jar."""
    app = spark.sparkContext.applicationId
    if app not in _processors:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / "Commands.java").read_text())
        # Spark's file distribution takes it from the driver whenever an executor starts, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="jar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"Commands-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for of, code in dict(compiler.getBytecodes()).items():
                jar.writestr(of.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(path)
        _processors[app] = compiler.getClassLoader().loadClass("tierstone.Commands").getDeclaredConstructors()[0].newInstance(None)
    return _processors[app]


def _log_files(spark: SparkSession, path: str) -> list:
    """The files of a log by their times, each with the lowest and highest seq in it."""
    files = spark.read.parquet(path).groupBy("_metadata.file_path", "_metadata.file_modification_time").agg(*(F.coalesce(f("seq"), F.lit(-(1 << 63))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))))
    return sorted(files.collect(), key=lambda r: (r["file_modification_time"], -r["low"]))


def _in_order(files: list) -> bool:
    return all(a["high"] < b["low"] for a, b in zip(files, files[1:], strict=False))


def _place(spark: SparkSession, file):
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file["file_path"]))


def _date(spark: SparkSession, files: list) -> None:
    """Gives files times a second apart, in the order of their seqs; a store that keeps no times leaves them as they are."""
    began = int(time.time()) - len(files)
    for i, file in enumerate(sorted(files, key=lambda r: r["low"])):
        place = _place(spark, file)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(place, (began + i) * 1000, -1)


def write_log(commands: DataFrame, path: str, file_rows: int | None = None) -> int:
    """Writes commands as a log of files of about file_rows commands, FILE_ROWS by default, and returns how many files.

    A stream takes files in the order of their times. Ranges of seq are written in parallel and then dated in their order; where the store
    keeps no times, they are copied to files one after another. Raises if the store's times do not tell the files apart even so.
    """
    spark, parts = commands.sparkSession, f"{path}-parts"
    write = lambda df: df.write.mode("append").option("maxRecordsPerFile", 0).option("parquet.block.size", GROUP_BYTES)
    n = -(-commands.count() // (file_rows or FILE_ROWS)) or 1
    write(commands.repartitionByRange(n, "seq")).parquet(parts)
    _date(spark, _log_files(spark, parts))
    files = _log_files(spark, parts)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (parts, path))
    store = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if _in_order(files) and not store.exists(new):
        if not store.rename(old, new):
            raise RuntimeError(f"{parts} cannot be renamed")
        return len(files)
    for file in sorted(files, key=lambda r: r["low"]):
        write(spark.read.schema(commands.schema).parquet(_place(spark, file).toString()).coalesce(1)).parquet(path)
    if not files:
        commands.limit(0).write.parquet(path)
    files = _log_files(spark, path)
    if not _in_order(files):
        raise RuntimeError("the store's times do not tell the files of the log apart")
    return len(files)


def files_for_batch(spark: SparkSession, path: str) -> int:
    """Files of a log that have some FILE_ROWS commands together: one, unless Spark was made to write more and smaller ones than write_log asked for."""
    found = spark.read.parquet(path).agg(F.count_distinct("_metadata.file_path").alias("files"), F.count("*").alias("commands")).first()
    return max(1, found["files"] * FILE_ROWS // max(1, found["commands"]))


def read_commands(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of command files. Backpressure is the number of files a batch takes; none is ever shed."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def replay_stream(commands: DataFrame, reap: bool = False) -> DataFrame:
    """Replies to a stream of commands, with one key's version as keyed state, in the executors' JVM."""
    spark = commands.sparkSession
    rows = commands.select(*(F.col(n).cast(kind).alias(n) for n, kind in (c.split() for c in COMMAND.split(", "))))
    return DataFrame(_processor(spark).replay(rows._jdf, reap, PART, STATE, REPLY), spark)


def run_available(replies: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs until all that is there now has been answered, and reads the answers. A stopped run goes on where its checkpoint is."""
    spark = replies.sparkSession
    # a batch is one file, so more tasks than cores would only open more state stores
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": tasks, "spark.sql.files.openCostInBytes": GROUP_BYTES}
    was = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        replies.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in was.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.parquet(path)
