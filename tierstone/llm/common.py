"""What several operators share: reading tables, scratch tables, expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words, as a Java pattern: the space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, as in tests on one machine, an own one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='tierstone-')}"
    return _own_dir


class Scratch:
    """Tables written to the shared folder. They cut lineage, are computed once and survive the loss of executors.

    Spark reads a result lazily, so a table that the result needs has to stay; drop() takes those that are not needed any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        give_back_driver(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hands what this process has freed back to the system, where the C library can; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back_driver(spark: SparkSession) -> bool:
    """The same in the driver's JVM, whose compilers and threads free much native memory that the C library keeps; False if this JVM has no command for it."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    try:
        # by its public interface, for the bean server's own class is not open to calls from outside
        kinds, values = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def tidy(of_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """of_batches, and after it what a task took goes back to the system: Spark keeps workers for tasks of other stages, whose memory adds to that of a whole pipeline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of_batches(batches)
        finally:
            give_back()

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else. lower() does that at once to a text of ASCII only."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of separators; an empty array for null."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_remove(F.split(text, separators), ""))


def own_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns of the caller cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


#: Rows of ids or short values that may be broadcast: 8 to 100 bytes each.
BROADCAST_ROWS = 500_000


def broadcast_few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it has few rows; else Spark plans the join by size. df should be a written table, for the count reads it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
