"""Seeded hash order: a permutation every engine can reproduce."""

from pyspark.sql import Column, functions as F

# Number of leading hex digits of the hash that name a bucket: 16 ** 4 = 65,536 buckets.
BUCKET_DIGITS = 4


def hash_key(row_id: Column, seed: int) -> Column:
    """md5 of 'seed:id' as text; sorting by it (then id) is the shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"))


def hash_bucket(key: Column) -> Column:
    return F.conv(F.left(key, F.lit(BUCKET_DIGITS)), 16, 10).cast("int")


def div(a: Column, b) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
