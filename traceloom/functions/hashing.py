"""Content hashes, keyed hashes and hash sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.text import as_col


def sha(value: Column | str) -> Column:
    return F.sha2(as_col(value).cast("binary"), 256)


def canonical_json(value: Column | str) -> Column:
    """JSON text with sorted keys and no spaces; null for text that is not JSON."""
    return F.to_json(F.try_parse_json(as_col(value)))


def json_hash(value: Column | str) -> Column:
    """Hash of a JSON text that does not depend on key order or spacing."""
    return sha(canonical_json(value))


def row_hash(*columns: str) -> Column:
    """Hash of named columns as JSON in name order; nested fields keep their schema order."""
    return sha(F.to_json(F.struct(*sorted(columns))))


def hash_ratio(value: Column | str) -> Column:
    """A stable number in [0, 1] from the first 64 bits of the hash of a text."""
    head = F.conv(F.substring(sha(value), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(float(0xFFFFFFFFFFFFFFFF))


def hmac_sha(key: bytes, message: Column | str) -> Column:
    """HMAC-SHA-256 as hex; only the two padded keys are made outside Spark.

    A key longer than a block is hashed first, as the standard says.
    """
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner = bytes(byte ^ 0x36 for byte in padded).hex()
    outer = bytes(byte ^ 0x5C for byte in padded).hex()
    digest = F.sha2(F.concat(F.unhex(F.lit(inner)), as_col(message).cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(digest)), 256)


def content_fingerprint(*columns: Column | str) -> list[Column]:
    """Order-free aggregates that identify a table's content whatever its file layout."""
    code = F.xxhash64(*columns)
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.sum(code.cast("decimal(20,0)")).alias("hash_sum"),
        F.bit_xor(code).alias("hash_xor"),
    ]
