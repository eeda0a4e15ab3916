import os
import random
from urllib.parse import urlsplit
from urllib.request import url2pathname

import pytest
from pyspark.sql import functions as F

from tests.test_machine import command
from tierstone.operators import machine
from tierstone.streaming import machine as stream


def log(spark, n=400):
    """A key with nine in ten of all commands, and others."""
    rows = [command(i, ("set", "get", "add", "delete", "replace")[i * 7 % 5], bytes=i) | {"digest": "hot" if i % 10 else f"d{i % 7}"} for i in range(n)]
    return spark.createDataFrame(rows, machine.COMMAND).repartition(3, "seq")


def test_a_log_is_files_of_few_commands_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    n = stream.write_log(log(spark), path, file_rows=100)
    files = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.first("_metadata.file_modification_time").alias("t"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"))
    files = sorted(files.collect(), key=lambda r: r["t"])
    assert n == len(files) > 1 and max(r["n"] for r in files) <= 200 and sum(r["n"] for r in files) == 400
    assert all(a["high"] < b["low"] for a, b in zip(files, files[1:], strict=False))


def test_a_stream_of_several_files_answers_as_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "PART", 16)
    stream.write_log(log(spark), f"file://{tmp_path}/log", file_rows=100)
    replies = stream.replay_stream(stream.read_commands(spark, f"file://{tmp_path}/log"))
    got = stream.run_available(replies, f"file://{tmp_path}/replies", f"file://{tmp_path}/checkpoint")
    assert sorted(map(str, got.collect())) == sorted(map(str, machine.replay(log(spark)).collect()))


def test_files_of_one_time_or_out_of_order_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream.F, "min", lambda c: F.max(F.lit(0)))
    with pytest.raises(RuntimeError, match="times"):
        stream.write_log(log(spark), f"file://{tmp_path}/log", file_rows=100)


def test_an_empty_log(spark, tmp_path):
    assert stream.write_log(log(spark).limit(0), f"file://{tmp_path}/log") <= 1
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 0


def streamed(spark, rows, tmp_path, file_rows=100, reap=False):
    stream.write_log(rows, f"file://{tmp_path}/log", file_rows=file_rows)
    replies = stream.replay_stream(stream.read_commands(spark, f"file://{tmp_path}/log"), reap)
    return stream.run_available(replies, f"file://{tmp_path}/replies", f"file://{tmp_path}/checkpoint")


def every_command(n=3000):
    """Commands of all verbs, with all columns, over few keys."""
    pick = random.Random(7)
    verbs = ("get", "gets", "set", "add", "replace", "cas", "delete", "mg", "ms", "md", "mn", "touch", None)
    rows = []
    for seq in range(n):
        row = command(seq, pick.choice(verbs), now=1000 + seq // 3, key=f"k{seq % 5}", flags=pick.randrange(9), exptime=pick.choice((0, 3, 40, 2_592_000, 2_592_001)), bytes=pick.randrange(99))
        row |= {"token": pick.choice((None, None, seq - pick.randrange(1, 40))), "noreply": pick.choice((None, False, False, True)), "rf": pick.choice((None, "", "fstck", "vkc", "vt")), "mode": pick.choice((None, "", "S", "E", "R", "SE", "X"))}
        row |= {"ttl": pick.choice((None, None, -1, 0, 5, 2_600_000, (1 << 32) + 7)), "opaque": pick.choice((None, "", "abc")), "quiet": pick.choice((None, False, False, True)), "good": pick.choice((None, True, True, True, False))}
        rows.append(row | {"digest": f"d{seq % 5}", "flags": None if row["verb"] == "ms" and pick.random() < 0.5 else row["flags"]})
    return rows


@pytest.mark.parametrize("reap", (False, True))
def test_every_command_is_answered_as_in_the_batch(spark, tmp_path, monkeypatch, reap):
    monkeypatch.setattr(stream, "PART", 50)
    rows = spark.createDataFrame(every_command(), machine.COMMAND).repartition(5)
    got = streamed(spark, rows, tmp_path, 1000, reap)
    assert sorted(map(str, got.collect())) == sorted(map(str, machine.replay(rows, reap).collect()))


def test_no_worker_of_python_folds_a_stream(spark, tmp_path):
    stream.write_log(log(spark), f"file://{tmp_path}/log")
    replies = stream.replay_stream(stream.read_commands(spark, f"file://{tmp_path}/log"))
    plan = replies._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "Py" not in plan


def test_tokens_beyond_the_whole_numbers_of_doubles(spark, tmp_path):
    big = 2**53
    rows = [command(big + 1, "set"), command(big + 2, "get"), command(big + 3, "cas", token=big + 1), command(big + 4, "cas", token=big + 2)]
    got = streamed(spark, spark.createDataFrame([r | {"digest": "d"} for r in rows], machine.COMMAND), tmp_path)
    assert {r["seq"] - big: r["reply"] for r in got.collect()} == {1: "STORED", 2: "VALUE k 0 5", 3: "STORED", 4: "EXISTS"}


def test_a_reply_with_a_size_that_is_null_is_null_as_in_sql(spark, tmp_path):
    rows = [command(1, "set", bytes=None), command(2, "get"), command(3, "delete")]
    got = streamed(spark, spark.createDataFrame([r | {"digest": "d"} for r in rows], machine.COMMAND), tmp_path)
    assert {r["seq"]: r["reply"] for r in got.collect()} == {1: "STORED", 2: None, 3: "DELETED"}


def test_a_log_is_written_once_and_dated(spark, tmp_path):
    n = stream.write_log(log(spark), f"file://{tmp_path}/log", file_rows=50)
    dates = sorted(p.stat().st_mtime for p in (tmp_path / "log").glob("*.parquet"))
    assert n == len(dates) > 4 and all(b - a == 1 for a, b in zip(dates, dates[1:], strict=False)) and not (tmp_path / "log-parts").exists()


def test_a_store_that_keeps_no_times(spark, tmp_path, monkeypatch):
    def backwards(_, files):
        for i, r in enumerate(sorted(files, key=lambda r: -r["low"])):
            os.utime(url2pathname(urlsplit(r["file_path"]).path), (10**9 + i, 10**9 + i))

    monkeypatch.setattr(stream, "_date", backwards)
    folder = tmp_path / "a folder"
    stream.write_log(log(spark), f"file://{folder}/log", file_rows=100)
    files = spark.read.parquet(f"file://{folder}/log").groupBy("_metadata.file_path").agg(F.first("_metadata.file_modification_time").alias("t"), F.min("seq").alias("low"), F.count("*").alias("n")).collect()
    by_time = sorted(files, key=lambda r: r["t"])
    assert by_time == sorted(files, key=lambda r: r["low"]) and sum(r["n"] for r in files) == 400 and len(files) > 2


def test_a_stream_has_no_more_state_stores_than_cores_and_leaves_the_settings(spark, tmp_path):
    was = dict(spark.conf.getAll)
    streamed(spark, log(spark), tmp_path)
    assert len([p for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit()]) == 3
    assert dict(spark.conf.getAll) == was


def test_files_smaller_than_meant_are_taken_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "FILE_ROWS", 100)
    n = stream.write_log(log(spark), f"file://{tmp_path}/log")
    assert 3 <= n <= 4 and stream.files_for_batch(spark, f"file://{tmp_path}/log") == 1
    n = stream.write_log(log(spark), f"file://{tmp_path}/small", file_rows=20)
    assert n > 15 and stream.files_for_batch(spark, f"file://{tmp_path}/small") == n * 100 // 400
