"""Key-based pseudo-random numbers: the same row gets the same number in any engine, layout or rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1000
HASH_DIGITS = 13  # hex digits of a key hash; 52 bits, exact in BIGINT and DOUBLE


def key_digest(key: Column, seed: int) -> Column:
    """Digest of the key's text and the seed; a null key has one too, so no row is without a place."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def key_hash(key: Column, seed: int) -> Column:
    """The leading hex digits of the keyed digest: uniform, and ordered as text like the number they write."""
    return F.substring(key_digest(key, seed), 1, HASH_DIGITS)


def key_bucket(key: Column, seed: int = 123) -> Column:
    """0 .. BUCKETS - 1 from the keyed digest, whatever the type or pattern of the keys."""
    return (F.conv(key_hash(key, seed), 16, 10).cast("bigint") % BUCKETS).cast("int")
