"""Signed tokens: keyed digests as column expressions, compared whole and valid until their time."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a block of SHA-256.
BLOCK = 64


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The key, digested if longer than a block, under the inner and the outer pad."""
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def keyed_digest(message: Column, key: bytes) -> Column:
    """HMAC with SHA-256 of a text, in hexadecimal; null for null."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signed(subject: Column, expires: Column, key: bytes) -> Column:
    """subject.expires.signature, where expires is in seconds; null if either is null."""
    body = F.concat_ws(".", F.base64(subject.cast("binary")), expires.cast("long").cast("string"))
    return F.when(subject.isNotNull() & expires.isNotNull(), F.concat(body, F.lit("."), keyed_digest(body, key)))


def verified(token: Column, now: Column, key: bytes) -> Column:
    """The subject of a token whose signature holds and that has not expired by `now` (seconds), else null.

    Signatures are compared by their digests, whose bytes tell nothing of where two differ.
    """
    parts = F.split(token, r"\.", -1)
    body = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    same = F.sha2(keyed_digest(body, key), 256) == F.sha2(F.get(parts, F.lit(2)), 256)
    until = F.try_to_number(F.get(parts, F.lit(1)), F.lit("9999999999999999")).cast("long")
    return F.when((F.size(parts) == 3) & same & (until > now), F.decode(F.try_to_binary(F.get(parts, F.lit(0)), F.lit("base64")), "UTF-8"))
