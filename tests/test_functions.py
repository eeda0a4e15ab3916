import pytest
from pyspark.sql import functions as F

from tierstone.config import KIB, MIB, Pool, StoreConfig, Tiers, parse_size
from tierstone.functions import http, identity, placement, protocol


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_digest_vectors(spark):
    rows = [("",), ("abc",), ("abcdbcdecdefdefgefghfghighijhijkijkljklmklmnlmnomnopnopq",)]
    got = [r[0] for r in values(spark, rows, "k string", identity.digest(F.col("k")))]
    assert got[0].startswith("e3b0c442") and got[1].startswith("ba7816bf") and got[2].startswith("248d6a61")
    assert values(spark, [("abc",)], "k string", identity.bucket(identity.digest(F.col("k"))).cast("string")) == [("16919744041952114874",)]


def test_layout(spark):
    two = placement.layout(F.col("s"), Tiers(), False)
    three = placement.layout(F.col("s"), Tiers(), True)
    assert values(spark, [(100 * MIB,), (100 * KIB,), (0,)], "s long", two["ssd"], two["hdd"]) == [(100 * MIB, 0), (0, 0), (0, 0)]
    assert values(spark, [(1024 * MIB,)], "s long", three["head"], three["ssd"], three["hdd"]) == [(256 * KIB, 32 * MIB, 992 * MIB)]


def test_place(spark):
    p = placement.place(F.col("o"), F.lit(32 * MIB))
    assert values(spark, [(0,), (32 * MIB - 1,), (32 * MIB,), (32 * MIB + 4096,)], "o long", p["tier"], p["local"]) == [("ssd", 0), ("ssd", 32 * MIB - 1), ("hdd", 0), ("hdd", 4096)]


def test_plan_reads(spark):
    reads = spark.createDataFrame([(0, 0, 256 * KIB)], "b long, off long, len long").withColumn("b", F.col("b").cast("decimal(20,0)"))
    segs = placement.plan_reads(reads, "b", "off", "len", 64 * KIB, 4).orderBy("chunk").collect()
    assert [s["drive"] for s in segs] == [0, 1, 2, 3] and all(s["seg_length"] == 64 * KIB for s in segs)
    one = placement.plan_reads(spark.createDataFrame([(0, 32 * KIB, 64 * KIB), (1, 5, 0)], "b long, off long, len long"), "b", "off", "len", 64 * KIB, 4).orderBy("chunk").collect()
    assert [(s["drive"], s["file_offset"], s["seg_length"]) for s in one] == [(0, 32 * KIB, 32 * KIB), (1, 0, 32 * KIB)]


def test_plan_wraps_at_64_bits(spark):
    assert values(spark, [(str(2**64 - 1), 3)], "b string, c long", placement.drive_of(F.col("b").cast("decimal(20,0)"), F.col("c"), 5)) == [(2,)]


def test_rounding(spark):
    assert values(spark, [(4097,)], "v long", placement.align_up(F.col("v")), placement.align_down(F.col("v"))) == [(8192, 4096)]
    rows = [(0,), (1,), (5 * KIB,), (4096,), (4097,), (64 * KIB,), (128 * KIB,)]
    assert [r[0] for r in values(spark, rows, "v long", placement.buddy_bytes(F.col("v"), 64 * KIB))] == [None, 4096, 8192, 4096, 8192, 65536, None]
    assert [r[0] for r in values(spark, [(0,), (1,), (64 * KIB,), (192 * KIB,), (6400 * KIB,)], "v long", placement.files_used(F.col("v"), 64 * KIB, 4))] == [0, 1, 1, 3, 4]
    assert [r[0] for r in values(spark, [(0,), (1,), (6,), (8,)], "v long", placement.is_power_of_two(F.col("v")))] == [False, True, False, True]


@pytest.mark.parametrize(
    ("host", "uri", "options", "key"),
    [
        ("", "/a/b/../c", {}, "/a/c"),
        ("", "//a///b", {}, "/a/b"),
        ("", "/../../etc/passwd", {}, "/etc/passwd"),
        ("WWW.Example.COM:8080", "/x", {"vhost": True}, "www.example.com/x"),
        ("", "/x", {"vhost": True}, None),
        ("", "/a/../", {}, "/index.html"),
        ("", "/a/", {"index_name": ""}, "/a"),
        ("", "/a?q=1/2", {}, "/a"),
        ("", "/a?q=%41", {"keep_query": True}, "/a?q=%41"),
        ("", "/foo", {"strip_slash": True}, "foo"),
        ("", "/%41+%zz", {}, "/A+%zz"),
        ("[::1]:80", "/x", {"vhost": True}, "[/x"),
    ],
)
def test_keys(spark, host, uri, options, key):
    assert values(spark, [(host, uri)], "h string, u string", http.derive_key(F.col("h"), F.col("u"), http.KeyOptions(**options))) == [(key,)]


def test_relpath_keys(spark):
    rel = F.col("r")
    assert values(spark, [("a%41b.txt",), ("blog/index.html",)], "r string", http.derive_key_from_relpath(rel)) == [("/a%41b.txt",), ("/blog/index.html",)]
    assert values(spark, [("A.test/x/y",), ("lone",)], "r string", http.derive_key_from_relpath(rel, http.KeyOptions(vhost=True))) == [("a.test/x/y",), ("lone/",)]


def test_ranges(spark):
    cases = {
        "bytes=0-99": (0, 100), "bytes=900-": (900, 100), "bytes=-50": (950, 50), "bytes=-5000": (0, 1000), "bytes=990-100000": (990, 10), "bytes=2000-3000": None,
        "bytes=0-1,3-4": None, "bytes=5-2": None, "bytes=-0": None, "items=0-9": None, "Bytes=0-9": None, "bytes=-": None, "bytes= 1-2 ": (1, 2), "bytes=99999999999999999999-": None,
    }
    r = http.resolve_range(http.parse_range(F.col("h")), F.lit(1000))
    got = values(spark, [(h,) for h in cases], "h string", r["off"], r["len"])
    assert [None if g == (None, None) else g for g in got] == list(cases.values())
    assert values(spark, [("bytes=-5",)], "h string", http.resolve_range(http.parse_range(F.col("h")), F.lit(0)).isNull()) == [(True,)]


def test_content_types(spark):
    cases = {"/a/b/logo.PNG": "image/png", "/app.js?v=2": "text/javascript; charset=utf-8", "/archive.tar.gz": "application/gzip", "/.bashrc": http.OCTETS, "/archive.": http.OCTETS, "/README": http.OCTETS, "/x.toolongext": http.OCTETS}
    assert [r[0] for r in values(spark, [(k,) for k in cases], "k string", http.content_type(F.col("k")))] == list(cases.values())
    assert len(http.TYPES) == 35


def test_heads(spark):
    p = http.parse_head(F.col("raw"))
    raw = [
        "GET /a HTTP/1.1\r\nHost:  a.test \r\nRange: bytes=0-9\r\n\r\n", "HEAD /b HTTP/1.1\r\n\r\nGET /c HTTP/1.1\r\n\r\n", "PURGE / HTTP/1.1\r\n\r\n", "GET /a HT", "nonsense\r\n\r\n",
        "GET / HTTP/1.0\r\nConnection: Keep-Alive\r\n\r\n", "GET / HTTP/1.0\r\n\r\n", "GET / HTTP/1.1\r\nConnection: CLOSE\r\nhost: x\r\nHOST: y\r\n\r\n",
    ]
    got = values(spark, [(r,) for r in raw], "raw string", p["status"], p["method"], p["host"], p["keep_alive"], p["consumed"])
    assert got[0] == ("ok", "GET", "a.test", True, len(raw[0])) and got[1][:2] == ("ok", "HEAD") and got[1][4] == raw[1].index("GET")
    assert got[2][:2] == ("ok", "other") and got[3][0] == "partial" and got[4][0] == "bad"
    assert [g[3] for g in got[5:]] == [True, False, False] and got[7][2] == "y"


def test_classic_commands(spark):
    c = protocol.parse_classic(F.col("l"))
    rows = ["set foo 7 0 5", "set bar 1 600 10 noreply", "cas foo 1 0 5 42", "set foo a b c", "", "get k other", "delete k noreply", "set k -1 0 5", "cas k 1 0 5", "get", "version", "incr k 1"]
    got = values(spark, [(r,) for r in rows], "l string", c["ok"], c["verb"], c["key"], c["flags"], c["exptime"], c["bytes"], c["cas"], c["noreply"])
    assert got[0] == (True, "set", "foo", 7, 0, 5, None, False) and got[1][-1] is True and got[2][6] == 42
    assert [g[0] for g in got[3:]] == [False, False, True, True, False, False, False, True, False] and got[6][-1] is True


def test_meta_commands(spark):
    m = protocol.parse_meta(F.col("l"))
    rows = ["mg foo v f s t c k T90 Oabc", "ms foo 5 F7 T300 C42 ME q", "mg foo Z", "mn", "mg", "ms foo x", "md foo C1 C2", "mg foo T-5", "ms foo 5 M"]
    got = values(spark, [(r,) for r in rows], "l string", m["ok"], m["verb"], m["key"], m["datalen"], F.array_join(m["rf"], ""), m["q"], m["f"], m["t"], m["c"], m["mode"], m["opaque"])
    assert got[0] == (True, "mg", "foo", None, "vfstck", False, None, 90, None, "S", "abc")
    assert got[1] == (True, "ms", "foo", 5, "", True, 7, 300, 42, "E", "")
    assert [g[0] for g in got[2:]] == [False, True, False, False, True, True, False] and got[6][8] == 2 and got[7][7] == -5


def test_expiry(spark):
    now = F.lit(1_000_000)
    got = values(spark, [(0,), (60,), (2592000,), (2592001,), (2000000000,)], "e long", protocol.expiry(F.col("e"), now))
    assert [g[0] for g in got] == [0, 1000060, 3592000, 2592001, 2000000000]
    assert [g[0] for g in values(spark, [(None,), (0,), (-1,), (60,)], "t long", protocol.meta_expiry(F.col("t"), now))] == [0, 0, 1, 1000060]


def test_config():
    good = StoreConfig()
    assert good.problem() is None
    bad = [StoreConfig(tiers=Tiers(64 * MIB)), StoreConfig(ssd=Pool()), StoreConfig(hdd=Pool(("h",), 64 * MIB)), StoreConfig(memcache=False, http=False), StoreConfig(https=True), StoreConfig(low_watermark=0.95)]
    assert all(c.problem() for c in bad) and StoreConfig(hdd=Pool(("h",), 4 * MIB)).problem() is None
    with pytest.raises(ValueError):
        bad[0].validated()
    assert [parse_size(x) for x in ("4G", "16m", "7", "1k", "x", "", "-1")] == [4 << 30, 16 << 20, 7, 1024, None, None, None]
    assert len(protocol.ERRORS) == 13


def test_meta_token_beyond_64_bits_is_refused(spark):
    """q22's SQL takes such tokens from seq 51,616 on; the protocol does not."""
    rows = spark.createDataFrame([(f"ms k 5 T300 C{2**64 - 1 + i}",) for i in (0, 1)], "line string").select(protocol.parse_meta(F.col("line")).alias("m")).collect()
    assert [(r["m"]["ok"], r["m"]["c"] and int(r["m"]["c"])) for r in rows] == [(True, 2**64 - 1), (False, None)]
