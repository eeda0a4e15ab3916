"""Command lines as columns: classic and meta verbs, expiry times, reply headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH, U32, U64 = 2_592_000, 4_294_967_295, 2**64 - 1
U64_TYPE = "decimal(20,0)"
CLASSIC = ("get", "gets", "set", "add", "replace", "cas", "delete", "version", "quit", "stats")
#: Error names, in the order of their numbers (fixed values).
ERRORS = ("ok", "not_found", "already_exists", "cas_mismatch", "out_of_space", "out_of_memory", "too_large", "invalid_argument", "invalid_protocol", "io_error", "unsupported", "backpressure_timeout", "would_block")


def unsigned(token: Column, most: int = U64) -> Column:
    """A whole token of digits, with any leading zeros, as a number of at most `most`, or null: a long up to 32 bits, else a decimal."""
    plain = F.regexp_replace(token, "^0+(?=[0-9])", "")
    value = F.when(token.rlike("^[0-9]+$") & (F.length(plain) <= 20), plain.try_cast(U64_TYPE))
    kept = F.when(value <= F.lit(str(most)).cast(U64_TYPE), value)
    return kept.cast("long") if most <= U32 else kept


def signed(token: Column) -> Column:
    """A whole token as a signed 64-bit number, or null."""
    return F.when(token.rlike("^-?[0-9]+$"), token.try_cast("long"))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda x: x != "")


def parse_classic(line: Column) -> Column:
    """struct(ok, verb, key, flags, exptime, bytes, cas, noreply). Tokens part at spaces; those beyond the seventh are ignored."""
    t = F.slice(_tokens(line), 1, 7)
    at = lambda i: F.get(t, F.lit(i))
    verb = at(0)
    stores = F.coalesce(verb.isin("set", "add", "replace", "cas"), F.lit(False))
    keyed = F.coalesce(verb.isin("get", "gets", "delete"), F.lit(False))
    flags, exptime, size, cas = unsigned(at(2), U32), unsigned(at(3), U32), unsigned(at(4)), unsigned(at(5))
    whole = flags.isNotNull() & exptime.isNotNull() & size.isNotNull() & ((verb != "cas") | cas.isNotNull())
    ok = F.coalesce(F.when(stores, whole).when(keyed, at(1).isNotNull()).otherwise(verb.isin(*CLASSIC)), F.lit(False))
    good = lambda x: F.when(ok & stores, x)
    noreply = F.when(verb == "cas", at(6)).when(verb == "delete", at(2)).otherwise(at(5)) == "noreply"
    return F.struct(
        ok.alias("ok"),
        F.when(ok, verb).alias("verb"),
        F.when(ok & (stores | keyed), at(1)).alias("key"),
        good(flags).alias("flags"),
        good(exptime).alias("exptime"),
        good(size).alias("bytes"),
        F.when(ok & (verb == "cas"), cas).alias("cas"),
        (ok & (stores | (verb == "delete")) & F.coalesce(noreply, F.lit(False))).alias("noreply"),
    )


def parse_meta(line: Column) -> Column:
    """struct(ok, verb, key, datalen, rf, q, f, t, c, mode, opaque). rf: the wanted fields among v f s t c k; a later flag wins."""
    t = _tokens(line)
    at = lambda i: F.get(t, F.lit(i))
    verb = at(0)
    flags = F.when(F.size(t) > 2, F.slice(t, F.when(verb == "ms", 4).otherwise(3), F.size(t))).otherwise(F.array().cast("array<string>"))
    last = lambda letter: F.substring(F.try_element_at(F.filter(flags, lambda x: x.startswith(letter)), F.lit(-1)), F.lit(2), F.lit(1 << 20))
    has = lambda letter: F.exists(flags, lambda x: x.startswith(letter))
    known = F.forall(
        flags,
        lambda x: F.substring(x, 1, 1).isin(*"vfstckqO")
        | (x.startswith("F") & unsigned(F.substring(x, F.lit(2), F.lit(1 << 20)), U32).isNotNull())
        | (x.startswith("T") & signed(F.substring(x, F.lit(2), F.lit(1 << 20))).isNotNull())
        | (x.startswith("C") & unsigned(F.substring(x, F.lit(2), F.lit(1 << 20))).isNotNull())
        | (x.startswith("M") & (F.length(x) > 1)),
    )
    ok = F.coalesce((verb == "mn") | (verb.isin("mg", "ms", "md") & at(1).isNotNull() & ((verb != "ms") | unsigned(at(2)).isNotNull()) & known), F.lit(False))
    keyed = ok & (verb != "mn")
    wanted = F.array_compact(F.array(*[F.when(has(c), c) for c in "vfstck"]))
    return F.struct(
        ok.alias("ok"),
        F.when(ok, verb).alias("verb"),
        F.when(keyed, at(1)).alias("key"),
        F.when(keyed & (verb == "ms"), unsigned(at(2))).alias("datalen"),
        F.when(keyed, wanted).alias("rf"),
        (keyed & has("q")).alias("q"),
        F.when(keyed, unsigned(last("F"), U32)).alias("f"),
        F.when(keyed, signed(last("T"))).alias("t"),
        F.when(keyed, unsigned(last("C"))).alias("c"),
        F.when(keyed, F.coalesce(F.substring(last("M"), 1, 1), F.lit("S"))).alias("mode"),
        F.when(keyed, F.coalesce(last("O"), F.lit(""))).alias("opaque"),
    )


def expiry(exptime: Column, now: Column) -> Column:
    """0 is never; up to 30 days is relative; beyond is absolute."""
    return F.when(exptime == 0, 0).when(exptime > MONTH, exptime).otherwise(now + exptime).cast("long")


def meta_expiry(ttl: Column, now: Column) -> Column:
    """A meta TTL: absent is 0; below 0 has expired already."""
    return F.when(ttl.isNull(), 0).when(ttl < 0, 1).otherwise(expiry(F.pmod(ttl, F.lit(U32 + 1)), now)).cast("long")


def live(expiry_: Column, now: Column) -> Column:
    return (expiry_ == 0) | (expiry_ > now)


def value_header(key: Column, flags: Column, size: Column, cas: Column | None = None) -> Column:
    return F.concat_ws(" ", F.lit("VALUE"), key, flags.cast("string"), size.cast("string"), *([] if cas is None else [cas.cast("string")]))


def meta_flags(rf: Column, flags: Column, size: Column, expiry_: Column, etag: Column, key: Column, opaque: Column, now: Column) -> Column:
    """The fields of a meta reply, each behind a space, in the fixed order f s t c k O."""
    ttl = F.when(expiry_ == 0, -1).otherwise(F.greatest(expiry_ - now, F.lit(0)))
    part = lambda letter, value: F.when(F.array_contains(rf, letter), F.concat(F.lit(f" {letter}"), value.cast("string"))).otherwise("")
    return F.concat(part("f", flags), part("s", size), part("t", ttl), part("c", etag), part("k", key), F.when(opaque != "", F.concat(F.lit(" O"), opaque)).otherwise(""))


#: Bytes that may be waiting for the end of their line before the connection is dropped.
MAX_LINE = 8192


def refusal(line: Column, blocking: bool = False) -> Column:
    """The reply to a line that no store has to be asked for: ERROR, CLIENT_ERROR and MN; null for all others. blocking: the mode that has neither meta verbs nor statistics."""
    classic = parse_classic(line)
    if blocking:
        return F.when(~classic["ok"] | (classic["verb"] == "stats"), "ERROR")
    meta = parse_meta(line)
    return F.when(line.rlike("^m[ngsd]( |$)"), F.when(~meta["ok"], "CLIENT_ERROR bad meta command").when(meta["verb"] == "mn", "MN")).when(~classic["ok"], "ERROR")


def split_lines(received: Column) -> Column:
    """struct(lines, rest, dropped) of received text without data blocks: its whole lines, what waits for more, and whether that is too long."""
    parts = F.split(received, "\r\n")
    rest = F.element_at(parts, -1)
    return F.struct(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("lines"), rest.alias("rest"), (F.octet_length(rest) > MAX_LINE).alias("dropped"))


def error_name(code: Column) -> Column:
    return F.coalesce(F.when(code >= 0, F.get(F.array(*[F.lit(e) for e in ERRORS]), code)), F.lit("unknown"))
