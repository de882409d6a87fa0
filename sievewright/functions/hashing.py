"""Content hashes, identifiers, keyed pseudonyms and hash-ranked draws."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON, in the given order; an identifier within this engine."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def short_id(*parts: Column, length: int = 16) -> Column:
    """The first digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, composed of native hashes."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), message.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), first), 256)


def pseudonym(key: bytes, *parts: Column, length: int = 24) -> Column:
    """A keyed identifier of the parts joined by NUL."""
    return F.substring(hmac_sha256(key, F.concat_ws("\0", *parts)), 1, length)


def rank_hash(seed: str, *parts: Column) -> Column:
    """What hash-ranked samples are ordered by."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def draw(seed: str, size: Column, *parts: Column) -> Column:
    """A number from 0 to size - 1 that the seed and the parts determine."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % size
