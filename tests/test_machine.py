from tierstone.operators.machine import Key, replay


def command(seq, verb, now=100, **more):
    base = {"seq": seq, "now": now, "verb": verb, "key": "k", "flags": 0, "exptime": 0, "bytes": 5, "token": None, "noreply": False, "rf": None, "mode": None, "ttl": None, "opaque": "", "quiet": False, "good": True}
    return base | more


def run(*commands):
    key = Key()
    return [key.apply(c)[0] for c in commands]


def test_classic_admission():
    assert run(command(1, "add"), command(2, "add"), command(3, "replace"), command(4, "delete"), command(5, "replace"), command(6, "delete")) == ["STORED", "NOT_STORED", "STORED", "DELETED", "NOT_STORED", "NOT_FOUND"]


def test_bad_trailer_and_noreply():
    assert run(command(1, "set", good=False), command(2, "get"), command(3, "set", noreply=True), command(4, "get")) == ["CLIENT_ERROR bad data chunk", "END", "", "VALUE k 0 5"]


def test_ttl():
    far = command(1, "set", exptime=4_000_000_000)
    past = command(1, "set", exptime=2_600_000, now=3_000_000)
    assert run(far, command(2, "get"))[1] == "VALUE k 0 5"
    assert run(past, command(2, "get", now=3_000_000), command(3, "add", now=3_000_000)) == ["STORED", "END", "STORED"]
    assert run(command(1, "set", exptime=10), command(2, "get", now=110), command(3, "delete", now=110)) == ["STORED", "END", "DELETED"]
    assert Key(reap=True).apply(command(1, "get"))[0] == "END"


def test_expired_key_is_gone_for_meta_delete_and_reaped_delete():
    assert run(command(1, "set", exptime=10), command(2, "md", now=200)) == ["STORED", "NF"]
    key = Key(reap=True)
    assert [key.apply(c)[0] for c in (command(1, "set", exptime=10), command(2, "delete", now=200))] == ["STORED", "NOT_FOUND"]


def test_cas():
    assert run(command(1, "cas", token=1), command(2, "set"), command(3, "cas", token=2), command(4, "cas", token=2), command(5, "gets")) == ["NOT_FOUND", "STORED", "STORED", "EXISTS", "VALUE k 0 5 3"]


def test_meta():
    out = run(
        command(1, "mn"), command(2, "ms", flags=7, bytes=10), command(3, "mg", rf="fst", opaque="x"), command(4, "ms", mode="E"), command(5, "ms", token=9), command(6, "ms", token=2, rf="ck"),
        command(7, "mg", rf="v", ttl=50), command(8, "md", token=1), command(9, "md", rf="k"), command(10, "mg"), command(11, "mg", quiet=True), command(12, "ms", mode="R"), command(13, "ms", mode="X"), command(14, "ms", token=1),
    )
    assert out == ["MN", "HD", "HD f7 s10 t-1 Ox", "NS", "EX", "HD c6 kk", "VA 5", "EX", "HD kk", "EN", "", "NS", "NS", "NF"]


def test_touch_revives_an_expired_version():
    assert run(command(1, "set", exptime=10), command(2, "mg", now=500, ttl=0), command(3, "get", now=10**9)) == ["STORED", "HD", "VALUE k 0 5"]


def test_replay_keeps_keys_apart_and_orders_them(spark):
    rows = [command(s, v) | {"digest": d} for d, s, v in [("a", 2, "get"), ("a", 1, "set"), ("b", 3, "get"), ("b", 4, "delete")]]
    schema = "digest string, seq long, now long, verb string, key string, flags long, exptime long, bytes long, token long, noreply boolean, rf string, mode string, ttl long, opaque string, quiet boolean, good boolean"
    got = {r["seq"]: r["reply"] for r in replay(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "STORED", 2: "VALUE k 0 5", 3: "END", 4: "NOT_FOUND"}
    assert replay(spark.createDataFrame([], schema)).count() == 0
