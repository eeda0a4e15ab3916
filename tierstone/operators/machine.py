"""The command state machine of one key, and its fold over ordered commands.

Commands are shuffled by digest and sorted in their partitions; a task then walks each key's commands once, in Arrow batches, with
the state of one key in hand. So a key with a third of all commands costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MONTH, U32 = 2_592_000, 1 << 32
#: Columns that a command has. line: the reply of a stream is text; rf: wanted fields of a meta command.
COMMAND = "digest string, seq long, now long, verb string, key string, flags long, exptime long, bytes long, token long, noreply boolean, rf string, mode string, ttl long, opaque string, quiet boolean, good boolean"
REPLY = "digest string, seq long, reply string, stored boolean, present boolean, size long, flags long, expiry long, etag long"
_NAMES = [c.split()[0] for c in COMMAND.split(", ")]


def expiry_of(exptime: int, now: int) -> int:
    return 0 if exptime == 0 else exptime if exptime > MONTH else now + exptime


def ttl_of(ttl: int | None, now: int) -> int:
    return 0 if ttl is None else 1 if ttl < 0 else expiry_of(ttl % U32, now)


class Key:
    """One key's state: absent, or (size, flags, expiry, etag). An etag is the seq of the store that made the version."""

    def __init__(self, state: tuple | None = None, reap: bool = False):
        self.state, self.reap = state, reap

    def live(self, now: int) -> bool:
        return self.state is not None and (self.state[2] == 0 or self.state[2] > now)

    def apply(self, c: dict) -> tuple[str, bool]:
        """The reply's first word or line ('' if none is sent) and whether a version was stored."""
        if self.reap and not self.live(c["now"]):
            self.state = None
        verb = c["verb"]
        if verb in ("mg", "ms", "md", "mn"):
            return getattr(self, "_" + verb)(c)
        if verb in ("get", "gets"):
            return self._get(c, verb == "gets")
        if verb == "delete":
            reply = "NOT_FOUND" if self.state is None else "DELETED"
            self.state = None
            return "" if c["noreply"] else reply, False
        return self._store(c)

    def _get(self, c: dict, cas: bool) -> tuple[str, bool]:
        if not self.live(c["now"]):
            return "END", False
        size, flags, _, etag = self.state
        return f"VALUE {c['key']} {flags} {size}" + (f" {etag}" if cas else ""), False

    def _store(self, c: dict) -> tuple[str, bool]:
        live, verb = self.live(c["now"]), c["verb"]
        refused = None
        if verb == "add" and live or verb == "replace" and not live:
            refused = "NOT_STORED"
        elif verb == "cas" and not live:
            refused = "NOT_FOUND"
        elif verb == "cas" and self.state[3] != c["token"]:
            refused = "EXISTS"
        if refused is None and c["good"] is False:
            return "" if c["noreply"] else "CLIENT_ERROR bad data chunk", False
        if refused is None:
            self.state = (c["bytes"], c["flags"], expiry_of(c["exptime"], c["now"]), c["seq"])
        return "" if c["noreply"] else refused or "STORED", refused is None

    def _mn(self, c: dict) -> tuple[str, bool]:
        return "MN", False

    def _fields(self, c: dict, wanted: str) -> str:
        size, flags, expiry, etag = self.state
        ttl = -1 if expiry == 0 else max(0, expiry - c["now"])
        values = {"f": flags, "s": size, "t": ttl, "c": etag, "k": c["key"]}
        return "".join(f" {x}{values[x]}" for x in "fstck" if x in wanted) + (f" O{c['opaque']}" if c["opaque"] else "")

    def _mg(self, c: dict) -> tuple[str, bool]:
        if c["ttl"] is not None and self.state is not None:  # a touch revives even what has expired
            self.state = (self.state[0], self.state[1], ttl_of(c["ttl"], c["now"]), self.state[3])
        if not self.live(c["now"]):
            return "" if c["quiet"] else "EN", False
        rf = c["rf"] or ""
        return (f"VA {self.state[0]}" if "v" in rf else "HD") + self._fields(c, rf), False

    def _ms(self, c: dict) -> tuple[str, bool]:
        live, mode, refused = self.live(c["now"]), c["mode"] or "S", None
        if c["token"] is not None:
            refused = "NF" if not live else "EX" if self.state[3] != c["token"] else None
        if refused is None and (mode not in "SER" or mode == "E" and live or mode == "R" and not live):
            refused = "NS"
        if refused:
            return refused, False
        if c["good"] is False:
            return "CLIENT_ERROR bad data chunk", False
        self.state = (c["bytes"], c["flags"] or 0, ttl_of(c["ttl"], c["now"]), c["seq"])
        return "" if c["quiet"] else "HD" + self._fields(c, "".join(x for x in (c["rf"] or "") if x in "ck")), True

    def _md(self, c: dict) -> tuple[str, bool]:
        if not self.live(c["now"]):
            reply = "NF"
        elif c["token"] is not None and self.state[3] != c["token"]:
            reply = "EX"
        else:
            self.state, reply = None, "HD" + (f" k{c['key']}" if "k" in (c["rf"] or "") else "") + (f" O{c['opaque']}" if c["opaque"] else "")
        return "" if c["quiet"] else reply, False


def _folding(reap: bool):
    types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in REPLY.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, key = None, Key(None, reap)
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                if c["digest"] != last:
                    last, key = c["digest"], Key(None, reap)
                reply, stored = key.apply(c)
                out.append((last, c["seq"], reply, stored, key.state is not None, *(key.state or (None,) * 4)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    return fold


def replay(commands: DataFrame, reap: bool = False) -> DataFrame:
    """For each command its reply, and the key's state after it. reap: expired versions vanish at once, else only once they are replaced or deleted."""
    ordered = commands.select(*_NAMES).repartition("digest").sortWithinPartitions("digest", "seq")
    return ordered.mapInArrow(_folding(reap), REPLY)
