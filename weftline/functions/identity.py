"""Keyed pseudonyms, stable hashes and names of media files."""

from __future__ import annotations

import hashlib
import hmac
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex from built-in functions. The key's pads are literals of the plan: don't persist its explain output."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def pseudonym(key: bytes, namespace: str, *values: Column) -> Column:
    """`<namespace>-` and 24 hex digits that depend on the key, the namespace and the values."""
    parts = [F.lit(namespace)]
    for v in values:
        parts += [F.lit("\0"), v.cast("string")]
    return F.concat(F.lit(f"{namespace}-"), F.substring(hmac_sha256(key, F.concat(*parts)), 1, 24))


def key_id(key: bytes, purpose: str = "key-id") -> str:
    """16 hex digits that name a key without giving it away."""
    return hmac.new(key, purpose.encode(), hashlib.sha256).hexdigest()[:16]


def stable_digest(seed: int | Column, *values: Column) -> Column:
    """Hex digest of seed and values; its order is the order of the random number that it stands for."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws("\x1f", first.cast("string"), *(v.cast("string") for v in values)), 256)


def stable_random(seed: int | Column, *values: Column) -> Column:
    """The digest's first 8 bytes as a number from 0 to 1."""
    head = F.substring(stable_digest(seed, *values), 1, 16)
    high, low = (F.conv(F.substring(head, k, 8), 16, 10).cast("double") for k in (1, 9))
    return (high * F.lit(2.0**32) + low) / F.lit(2.0**64)


def canonical_digest(payload: Any, length: int = 64) -> str:
    """sha256 of canonical JSON, on the driver."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:length]


def media_name(path: Column) -> tuple[Column, Column]:
    """Post id and ordinal from a media file's name `<prefix>_<post id>[_<ordinal>].<ext>`; nulls where it has no id."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_")
    second = F.when(F.size(parts) >= 2, F.get(parts, F.lit(1)))
    post = F.when(second.rlike(r"^\d+$"), second)
    last = F.element_at(parts, -1)
    ordinal = F.when((F.size(parts) >= 3) & last.rlike(r"^\d+$"), last.try_cast("int")).otherwise(F.lit(1))
    return post, F.when(post.isNotNull(), ordinal)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, `<none>` for names without."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    return F.when(found == "", F.lit("<none>")).otherwise(found)
