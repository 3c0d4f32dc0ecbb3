"""Keyed identities: HMAC-SHA-256 composed of JVM functions, so no key material or value passes through Python workers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Hex HMAC-SHA-256 of a string or binary column under a key known to the driver; null stays null."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def identity(kind: str, parts: list[Column], key: bytes) -> Column:
    """Identity of a tuple of texts of one kind: the HMAC of its JSON array, so no two tuples share a text."""
    return hmac_sha256(F.to_json(F.array(F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), key)


def short(digest: Column) -> Column:
    """The upper 64 bits of a hex digest, as an unsigned decimal."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
