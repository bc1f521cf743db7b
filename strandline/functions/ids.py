"""Stable ids and hashes as JVM expressions."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name space of the ids.
NAMESPACE = uuid.NAMESPACE_URL


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name, as a string; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    # version 5 in the 13th digit, variant 10 in the top bits of the 17th
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def content_id(source: Column, body: Column, occurrence: Column) -> Column:
    """The id of a chunk by its content: it survives a rebuild that leaves the body as it is."""
    return digest_id(source, F.sha1(body), occurrence)


def digest_id(source: Column, digest: Column, occurrence: Column) -> Column:
    """``content_id`` by the SHA-1 of the body."""
    return uuid5(F.concat(source, F.lit("#v4#"), F.substring(digest, 1, 20), F.lit("#"), occurrence.cast("string")))


def position_id(source: Column, index: Column) -> Column:
    """The id of a page by its position."""
    return uuid5(F.concat(source, F.lit("#v3#"), index.cast("string")))


def term_index(term: Column) -> Column:
    """A term's number in a hashed sparse vector, below 2^31."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % F.lit(2**31)


def draw(*parts: Column | str | int) -> Column:
    """A reproducible random number in [0, 1) of its parts: the first 8 digits of an MD5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


# The steps of a 32-bit mixer whose outputs for 0, 1, 2 ... are as random; plain integer arithmetic, so that arrays, expressions and SQL agree.
GOLDEN, MIX_A, MIX_B = 2654435769, 2246822507, 3266489909
_MASK = 0xFFFFFFFF


def _times(x: Column, by: int) -> Column:
    """x * by modulo 2^32, in two halves that do not overflow."""
    high = F.shiftleft((x * F.lit(by >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (x * F.lit(by & 0xFFFF) + high).bitwiseAND(F.lit(_MASK))


def mixed(base: Column, n: Column) -> Column:
    """The n-th random number of 32 bits of a stream that begins at ``base`` (both longs, n below 2^31)."""
    x = (base + n * F.lit(GOLDEN)).bitwiseAND(F.lit(_MASK))
    x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, 16)), MIX_A)
    x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, 13)), MIX_B)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def mixed_array(base: int, n: np.ndarray) -> np.ndarray:
    """``mixed`` for an array of numbers (unsigned 64-bit)."""
    mask = np.uint64(_MASK)
    x = (np.uint64(base) + n * np.uint64(GOLDEN)) & mask
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX_A)) & mask
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(MIX_B)) & mask
    return x ^ (x >> np.uint64(16))


def stream_of(*parts: object) -> int:
    """Where the stream of some parts begins: the first 8 digits of an MD5, as ``draw`` takes them."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
