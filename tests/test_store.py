from decimal import Decimal

from pyspark.sql import functions as F

from tierstone.functions import placement, protocol
from tierstone.operators import chunks, tenants
from tierstone.plans import views as V


def test_parts_of_a_read_cover_it_once(spark):
    sizes = [0, 1, 4096, 4097, 16384, 16385, 50_000]
    rows = [(s, o, n, h) for s in sizes for o in (0, 100, 5000, 20_000) for n in (0, 1, 4096, 60_000) for h in (0, 4096)]
    reads = spark.createDataFrame(rows, "size long, off long, len long, head long").where("head = 0 OR size >= head").withColumn("id", F.monotonically_increasing_id()).cache()
    parts = {}
    for r in placement.tier_parts(reads, "off", "len", "head", V.SMALL).collect():
        parts.setdefault(r["id"], []).append(r)
    for r in reads.collect():
        # objects that fit their head have nothing on disk, so a read of them without a head covers nothing
        if r["size"] <= V.SMALL.ram_head and not r["head"]:
            continue
        got, want = sorted(parts.get(r["id"], []), key=lambda p: p["at"]), max(min(r["len"], r["size"] - r["off"]), 0)
        assert sum(p["part_length"] for p in got) == want
        at = 0
        for p in got:
            assert p["at"] == at
            at += p["part_length"]


def test_refused_lines(spark):
    lines = ["get k", "mg k v", "mg k Z", "mn", "mnx", "stats", "", "MG k", "ms k x", "quit", "set k 1 1", None]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(protocol.refusal(F.col("line")).alias("r"), protocol.refusal(F.col("line"), True).alias("b")).collect()
    bad = "CLIENT_ERROR bad meta command"
    assert [r["r"] for r in got] == [None, None, bad, "MN", "ERROR", None, "ERROR", "ERROR", bad, None, "ERROR", "ERROR"]
    assert [r["b"] for r in got] == [None, "ERROR", "ERROR", "ERROR", "ERROR", "ERROR", "ERROR", "ERROR", "ERROR", None, "ERROR", "ERROR"]


def test_lines_of_a_blob(spark):
    blobs = ["", "a", "a\r\n", "a\r\n\r\nb", "x" * 8192, "x" * 8193, "x" * 9000 + "\r\n"]
    got = [r["s"] for r in spark.createDataFrame([(b,) for b in blobs], "b string").select(protocol.split_lines(F.col("b")).alias("s")).collect()]
    assert [g["lines"] for g in got] == [[], [], ["a"], ["a", ""], [], [], ["x" * 9000]]
    assert [g["rest"] for g in got] == ["", "a", "", "b", "x" * 8192, "x" * 8193, ""] and [g["dropped"] for g in got] == [False] * 5 + [True, False]


def test_chunks_give_back_what_was_cut(spark):
    value = bytes(range(256)) * 9
    values = spark.createDataFrame([("a", Decimal(2**63), value), ("b", Decimal(0), b""), ("c", Decimal(1), None)], "digest string, bucket decimal(20,0), value binary")
    cut = chunks.to_chunks(values, 100, 3).cache()
    assert cut.count() == 24 and {r["drive"] for r in cut.collect()} == {0, 1, 2}
    spans = [(0, 0, 1), (1, 99, 2), (2, 0, 5000), (3, 2303, 9), (4, 2304, 9), (5, 100, 100), (6, 7, 0)]
    reads = spark.createDataFrame([(i, d, o, n) for i, o, n in spans for d in ("a",)] + [(9, "b", 0, 5), (10, "none", 0, 5)], "read long, digest string, off long, len long")
    got = {r["read"]: bytes(r["value"]) for r in chunks.gather(cut, reads, 100).collect()}
    assert got == {i: value[o : o + n] for i, o, n in spans if value[o : o + n]}


def test_tenants(spark):
    known = spark.createDataFrame([("a.test", "A")], "host string, certificate string")
    rows = spark.createDataFrame([(1, "A.Test", "a.test:443"), (2, None, "x"), (3, "b.test", "b.test."), (4, "", None), (5, "a.test", "b.test"), (6, "a.test", None)], "id int, sni string, host string")
    assert {r["id"]: r["certificate"] for r in tenants.select_certificate(rows, known).collect()} == {1: "A", 2: None, 3: None, 4: None, 5: "A", 6: "A"}
    assert {r["id"]: r["host_ok"] for r in tenants.misdirected(rows).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
