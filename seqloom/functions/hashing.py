"""Deterministic order and uniforms from SHA-256, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_digest(seed: int | str, key: Column) -> Column:
    """Hex SHA-256 of the seed as text, a zero character and the key; hex order is digest order."""
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("\0"), key.cast("string")), 256)


def u64(value: Column) -> Column:
    """Eight big-endian bytes of a non-negative number."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))


def frame(value: Column) -> Column:
    """A byte string behind its length, so that joined frames can't be read two ways."""
    raw = value.cast("binary")
    return F.concat(u64(F.length(raw)), raw)


def framed_digest(domain: bytes, *parts: Column) -> Column:
    """Hex SHA-256 of a domain and parts that are framed or u64 already."""
    return F.sha2(F.concat(F.lit(bytearray(domain)), *parts), 256)


def uniform(digest: Column) -> Column:
    """A number in [0, 1) from the first eight bytes of a hex digest."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def event_uniform(event: str, seed: int, *keys: Column) -> Column:
    """A uniform for one named event of one unit: the same wherever and whenever it is computed."""
    return uniform(F.sha2(F.concat_ws("|", F.lit(event), F.lit(str(seed)), *(k.cast("string") for k in keys)), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex, from two nested digests of padded keys (RFC 2104)."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in key)), F.unhex(inner)), 256)
