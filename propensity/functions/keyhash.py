"""A key hash in plain arithmetic, the same in every engine and for every data layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A linear congruential step modulo the Mersenne prime 2^31 - 1.
MODULUS = 2147483647
MULTIPLIER = 1103515245
INCREMENT = 12345
# Another step, for folds, which must not depend on the split.
FOLD_MULTIPLIER = 1566083941
FOLD_INCREMENT = 2531011


def key_hash(key: Column, multiplier: int = MULTIPLIER, increment: int = INCREMENT) -> Column:
    """Hash of an integer key in [0, 2^31 - 1); NULL hashes like 0.

    The key is reduced first, so that the product fits in 64 bits for any key. For keys of other types pass
    ``F.xxhash64(key)``.
    """
    reduced = F.pmod(F.coalesce(key.cast("bigint"), F.lit(0)), F.lit(MODULUS))
    return F.pmod(reduced * multiplier + increment, F.lit(MODULUS))


def hash_bucket(
    key: Column, buckets: int = 100, multiplier: int = MULTIPLIER, increment: int = INCREMENT
) -> Column:
    """Bucket number of a key in [0, buckets)."""
    return F.pmod(key_hash(key, multiplier, increment), F.lit(buckets))
