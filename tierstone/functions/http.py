"""HTTP requests as columns: key derivation, ranges, content types, status and heads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierstone.functions.protocol import U64_TYPE, unsigned

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OCTETS = "application/octet-stream"
#: Content types by extension (fixed values).
TYPES = {
    "html": "text/html; charset=utf-8",
    "htm": "text/html; charset=utf-8",
    "css": "text/css; charset=utf-8",
    "js": "text/javascript; charset=utf-8",
    "mjs": "text/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8",
    "map": "application/json; charset=utf-8",
    "xml": "application/xml; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
    "csv": "text/csv; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "svg": "image/svg+xml; charset=utf-8",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "avif": "image/avif",
    "ico": "image/x-icon",
    "bmp": "image/bmp",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "eot": "application/vnd.ms-fontobject",
    "wasm": "application/wasm",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "gz": "application/gzip",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "ogg": "audio/ogg",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "ics": "text/calendar; charset=utf-8",
}


@dataclass(frozen=True)
class KeyOptions:
    vhost: bool = False
    keep_query: bool = False
    strip_slash: bool = False
    index_name: str = "index.html"


def percent_decode(s: Column) -> Column:
    """%hh becomes its byte; a malformed % and every + stay. Columns of text hold UTF-8: decoded bytes that are none become U+FFFD, where a server would keep them."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(s, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_path(p: Column) -> Column:
    """Segments without '', '.' and what '..' takes back; '..' stops at the root."""
    empty = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(p, "/"), empty, step), "/"))


def normalize_host(h: Column) -> Column:
    """Before the first colon, without final dots, A-Z lowered."""
    return F.translate(F.regexp_replace(F.substring_index(h, ":", 1), r"\.+$", ""), UPPER, LOWER)


def _joined(host: Column | None, path: Column, query: Column, o: KeyOptions) -> Column:
    path = F.concat(path, query) if o.keep_query else path
    if o.vhost:
        return F.when(host == "", F.lit(None)).otherwise(F.concat(host, path))
    return F.regexp_replace(path, "^/", "") if o.strip_slash else path


def derive_key(host: Column, uri: Column, o: KeyOptions = KeyOptions()) -> Column:
    """The key that a request names; null if a virtual host is asked for and there is none."""
    plain = F.substring_index(uri, "#", 1)
    raw = F.substring_index(plain, "?", 1)
    query = F.substring(plain, F.length(raw) + 1, F.length(plain))
    if o.index_name:
        raw = F.when((raw == "") | raw.endswith("/"), F.concat(raw, F.lit(o.index_name))).otherwise(raw)
    return _joined(normalize_host(host), canonical_path(percent_decode(raw)), query, o)


def derive_key_from_relpath(relpath: Column, o: KeyOptions = KeyOptions()) -> Column:
    """The key that a loaded file gets: not decoded, no index name; in virtual-host mode its first component is the host."""
    if o.vhost:
        first = F.substring_index(relpath, "/", 1)
        rest = F.substring(relpath, F.length(first) + 1, F.length(relpath))
        return F.concat(normalize_host(first), canonical_path(rest))
    return _joined(None, canonical_path(relpath), F.lit(""), o)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_range(header: Column) -> Column:
    """struct(kind, a, b) of one byte range; null if the header has none that holds. Blanks may stand around the header and both its numbers, which are unsigned 64-bit with any leading zeros."""
    range_ = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast(U64_TYPE).alias("a"), y.cast(U64_TYPE).alias("b"))
    spec = r"^[ \t]*bytes=[ \t]*([0-9]*)[ \t]*-[ \t]*([0-9]*)[ \t]*$"

    def parsed(p: Column) -> Column:
        a, b = unsigned(p["low"]), unsigned(p["high"])
        return (
            F.when((p["low"] == "") & (b > 0), range_("suffix", b, F.lit(0)))
            .when((p["high"] == "") & a.isNotNull(), range_("from", a, F.lit(0)))
            .when((p["low"] != "") & (p["high"] != "") & (b >= a), range_("closed", a, b))
        )

    ends = F.when(header.rlike(spec), F.struct(F.regexp_extract(header, spec, 1).alias("low"), F.regexp_extract(header, spec, 2).alias("high")))
    return _let(ends, parsed)


def resolve_range(r: Column, size: Column) -> Column:
    """struct(off, len); null if the range lies outside."""
    n = F.least(r["a"], size)
    at = lambda off, length: F.struct(off.cast("long").alias("off"), length.cast("long").alias("len"))
    return (
        F.when((r["kind"] == "suffix") & (size > 0), at(size - n, n))
        .when((r["kind"] == "from") & (r["a"] < size), at(r["a"], size - r["a"]))
        .when((r["kind"] == "closed") & (r["a"] < size), at(r["a"], F.least(r["b"], size - 1) - r["a"] + 1))
    )


def content_type(key: Column) -> Column:
    name = F.substring_index(F.substring_index(key, "?", 1), "/", -1)
    ext = F.translate(F.regexp_extract(name, r"^.+\.([^.]{1,8})$", 1), UPPER, LOWER)
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit(OCTETS))


def none_match(header: Column, etag: Column) -> Column:
    """If-None-Match holds if the header has a * anywhere or the quoted tag."""
    return F.coalesce(F.contains(header, F.lit("*")) | F.contains(header, etag), F.lit(False))


def evaluate(method: Column, found: Column, key: Column, size: Column, etag: Column, range_header: Column, inm: Column, host_ok: Column | None = None) -> Column:
    """struct(status, body_off, body_len, content_range), in the order in which a server decides."""
    host_ok = F.lit(True) if host_ok is None else host_ok
    nothing, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    answer = lambda status, off=nothing, length=nothing, span=none: F.struct(F.lit(status).alias("status"), off.alias("body_off"), length.alias("body_len"), span.alias("content_range"))
    whole = answer(200, nothing, F.when(method == "HEAD", 0).otherwise(size).cast("long"))

    def ranged(r: Column) -> Column:
        span = lambda hit: F.concat(F.lit("bytes "), hit["off"].cast("string"), F.lit("-"), (hit["off"] + hit["len"] - 1).cast("string"), F.lit("/"), size.cast("string"))
        outside = answer(416, span=F.concat(F.lit("bytes */"), size.cast("string")))
        found_ = _let(resolve_range(r, size), lambda hit: F.when(hit.isNull(), outside).otherwise(answer(206, hit["off"], hit["len"], span(hit))))
        return F.when(r.isNull(), whole).otherwise(found_)

    return (
        F.when(~host_ok, answer(421))
        .when(~method.isin("GET", "HEAD"), answer(405))
        .when(key.isNull(), answer(400))
        .when(~found, answer(404))
        .when(none_match(inm, etag), answer(304))
        .when(method == "GET", _let(parse_range(range_header), ranged))
        .otherwise(whole)
    )


def response_head(status: Column, size: Column, body_len: Column, type_: Column, etag: Column, content_range: Column, keep_alive: Column) -> Column:
    """The head of each answer. Errors close the connection; an empty object names no type; 304 has a tag alone, 416 none."""
    last = lambda keep: F.concat(F.lit("Connection: "), F.when(keep, "keep-alive").otherwise("close"), F.lit("\r\n\r\n"))
    number = lambda n: F.concat(F.lit("Content-Length: "), n.cast("string"), F.lit("\r\n"))
    tag = F.concat(F.lit("ETag: "), etag, F.lit("\r\n"))
    typed = F.concat(F.lit("Content-Type: "), type_, F.lit("\r\n"))
    ranged = F.concat(F.lit("Content-Range: "), content_range, F.lit("\r\n"))
    closed = F.lit("HTTP/1.1 "), F.lit("\r\nContent-Length: 0\r\n"), last(F.lit(False))
    error = lambda line, extra="": F.concat(closed[0], F.lit(line), closed[1], F.lit(extra), closed[2])
    return (
        F.when(status == 200, F.concat(F.lit("HTTP/1.1 200 OK\r\n"), number(size), F.when(size > 0, F.concat(typed, F.lit("Accept-Ranges: bytes\r\n"))).otherwise(""), tag, last(keep_alive)))
        .when(status == 206, F.concat(F.lit("HTTP/1.1 206 Partial Content\r\n"), ranged, number(body_len), typed, tag, last(keep_alive)))
        .when(status == 304, F.concat(F.lit("HTTP/1.1 304 Not Modified\r\n"), tag, last(keep_alive)))
        .when(status == 416, F.concat(F.lit("HTTP/1.1 416 Range Not Satisfiable\r\n"), ranged, number(F.lit(0)), last(keep_alive)))
        .when(status == 404, F.concat(F.lit("HTTP/1.1 404 Not Found\r\n"), number(F.lit(0)), last(keep_alive)))
        .when(status == 405, error("405 Method Not Allowed", "Allow: GET, HEAD\r\n"))
        .when(status == 421, error("421 Misdirected Request"))
        .otherwise(error("400 Bad Request"))
    )


def parse_head(raw: Column) -> Column:
    """struct(status, method, target, host, range, if_none_match, keep_alive, minor, consumed) of the first request in raw; status is ok, partial or bad."""
    end = F.instr(raw, "\r\n\r\n")
    lines = F.split(F.substring(raw, F.lit(1), F.greatest(end - 1, F.lit(0))), "\r\n")
    first = F.element_at(lines, 1)
    ok = first.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+ [^ ]+ HTTP/1\.[01]$") & F.forall(F.slice(lines, 2, 65), lambda x: x.rlike("^[^: \t][^:]*:")) & (F.size(lines) <= 65)
    named = lambda name: F.regexp_replace(F.try_element_at(F.filter(lines, lambda x: x.rlike(f"(?i)^{name}:")), F.lit(-1)), r"(?i)^[^:]*:[ \t]*|[ \t]+$", "")
    method, minor = F.substring_index(first, " ", 1), F.substring(first, -1, 1).cast("string")
    connection = F.translate(named("connection"), UPPER, LOWER)
    keep = F.when(connection.isNotNull(), connection != "close").otherwise(minor == "1")
    return F.struct(
        F.when(end == 0, "partial").when(ok, "ok").otherwise("bad").alias("status"),
        F.when(method.isin("GET", "HEAD"), method).otherwise("other").alias("method"),
        F.regexp_extract(first, "^[^ ]+ ([^ ]+) ", 1).alias("target"),
        F.coalesce(named("host"), F.lit("")).alias("host"),
        parse_range(named("range")).alias("range"),
        named("if-none-match").alias("if_none_match"),
        keep.alias("keep_alive"),
        F.when(end > 0, end + 3).otherwise(0).alias("consumed"),
    )
