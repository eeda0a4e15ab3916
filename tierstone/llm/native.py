"""Java classes beside this file, compiled by the compiler that Spark brings along, handed to the executors in a jar, and called as SQL functions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_added: dict[str, object] = {}


def function(spark: SparkSession, name: str, returns: str) -> str:
    """The SQL function of the class tierstone.<name>, for this session; compiled once for an application."""
    sql, app = f"tierstone_{name.lower()}", f"{spark.sparkContext.applicationId} {name}"
    jvm = spark._jvm
    if app not in _added:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / f"{name}.java").read_text())
        # Spark's file distribution takes it from the driver whenever an executor starts, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="jar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for of, code in dict(compiler.getBytecodes()).items():
                jar.writestr(of.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(path)
        _added[app] = compiler.getClassLoader().loadClass(f"tierstone.{name}").getDeclaredConstructors()[0].newInstance(None)
    spark._jsparkSession.udf().register(sql, _added[app], jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return sql


def hand_out(spark: SparkSession, name: str, content: bytes) -> str:
    """Hands a file to the executors, and returns its name there."""
    # Spark's file distribution takes it from the driver whenever an executor starts, so it stays until the driver ends
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}.bin")
    Path(path).write_bytes(content)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)
