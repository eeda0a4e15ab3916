"""Typed parameters of the object store and their invariants."""

from __future__ import annotations

from dataclasses import dataclass, field

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
DEVICE_BLOCK = 4 * KIB
MAX_OBJECT = GIB


def parse_size(text: str) -> int | None:
    """Digits with an optional suffix k, m or g (either case); None if it is anything else."""
    scale = {"k": KIB, "m": MIB, "g": GIB}.get(text[-1:].lower(), 1)
    digits = text[:-1] if scale > 1 else text
    return int(digits) * scale if digits.isascii() and digits.isdigit() else None


def power_of_two(v: int) -> bool:
    return v > 0 and v & (v - 1) == 0


@dataclass(frozen=True)
class Tiers:
    """Bytes of an object's head in memory, and of its beginning on SSD; the rest is on HDD if there is one."""

    ram_head: int = 256 * KIB
    ssd_prefix: int = 32 * MIB


@dataclass(frozen=True)
class Pool:
    dirs: tuple[str, ...] = ()
    stripe_unit: int = 64 * KIB


@dataclass(frozen=True)
class Memory:
    total_bytes: int = GIB
    block_bytes: int = MIB


@dataclass(frozen=True)
class StoreConfig:
    memory: Memory = Memory()
    tiers: Tiers = Tiers()
    ssd: Pool = field(default_factory=lambda: Pool(("ssd0",)))
    hdd: Pool = Pool()
    io_chunk_bytes: int = 256 * KIB
    io_buffers: int = 64
    low_watermark: float = 0.8
    high_watermark: float = 0.9
    max_objects: int = 0
    memcache: bool = True
    http: bool = True
    https: bool = False
    tls_certs: tuple[str, ...] = ()
    tls_keys: tuple[str, ...] = ()

    @property
    def three_layer(self) -> bool:
        return bool(self.hdd.dirs)

    def problem(self) -> str | None:
        """The first invariant that does not hold, or None."""
        m, t, aligned = self.memory, self.tiers, lambda v: v % DEVICE_BLOCK == 0
        checks = (
            (power_of_two(m.block_bytes) and m.block_bytes >= DEVICE_BLOCK, "memory blocks must be a power of two of at least 4 KiB"),
            (m.total_bytes >= m.block_bytes, "memory must hold a block"),
            (t.ram_head <= t.ssd_prefix, "the head must not exceed the SSD prefix"),
            (aligned(t.ram_head) and aligned(t.ssd_prefix), "tier sizes must be multiples of 4 KiB"),
            (t.ssd_prefix <= MAX_OBJECT, "the SSD prefix exceeds the largest object"),
            (t.ram_head <= m.block_bytes, "the head must fit a memory block"),
            (power_of_two(self.io_chunk_bytes) and self.io_chunk_bytes >= DEVICE_BLOCK, "I/O chunks must be a power of two of at least 4 KiB"),
            (self.io_buffers > 0, "there must be an I/O buffer"),
            (bool(self.ssd.dirs), "there must be an SSD directory"),
            (self.ssd.stripe_unit > 0 and aligned(self.ssd.stripe_unit), "the SSD stripe must be a positive multiple of 4 KiB"),
            (not self.three_layer or (self.hdd.stripe_unit > 0 and aligned(self.hdd.stripe_unit)), "the HDD stripe must be a positive multiple of 4 KiB"),
            (not self.three_layer or t.ssd_prefix - t.ram_head >= self.hdd.stripe_unit, "the SSD part must cover an HDD stripe"),
            (0 < self.low_watermark < self.high_watermark <= 1, "watermarks must rise within (0, 1]"),
            (self.memcache or self.http or self.https, "there must be a listener"),
            (len(self.tls_certs) == len(self.tls_keys), "each certificate needs a key"),
            (not self.https or bool(self.tls_certs), "HTTPS needs a certificate"),
        )
        return next((message for ok, message in checks if not ok), None)

    def validated(self) -> StoreConfig:
        if message := self.problem():
            raise ValueError(message)
        return self
