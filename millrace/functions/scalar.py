"""Scalar expressions, all on the JVM."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash range of the stream sketches.
PRIME, BITS = 1_000_003, 69_997


def short_year(date: Column) -> Column:
    """m/d/yyyy to m/d/yy, by position."""
    return F.concat(F.substring(date, F.lit(1), F.greatest(F.length(date) - 4, F.lit(0))), F.right(date, F.lit(2)))


def unquoted(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def without_zeros(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))


def first_char_bucket(key: Column, n: int) -> Column:
    return F.ascii(F.substring(key, 1, 1)) % n


def noise_ordinal(level: Column, default: int) -> Column:
    return F.when(level == "quiet", 1).when(level == "average", 2).when(level == "loud", 3).when(level == "very_loud", 4).otherwise(default)


def wifi_ordinal(kind: Column) -> Column:
    return F.when(kind == "free", 2).when(kind == "no", 0).otherwise(-1)


def byte_fold(text: Column, prime: int = PRIME) -> Column:
    """The UTF-8 bytes read as one big number, modulo a prime."""
    digits = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(text.cast("binary")), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(F.octet_length(text) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, b: (acc * 256 + b) % prime))


def hash_parameters(k: int, seed: int, prime: int = PRIME) -> list[tuple[int, int]]:
    """k pairs (a, b) below the prime, the same ones for a seed."""
    rng = random.Random(seed)
    return [(rng.randrange(1, prime), rng.randrange(prime)) for _ in range(k)]


def affine_hash(x: Column, a: int, b: int, prime: int = PRIME, size: int = BITS) -> Column:
    """((a x + b) mod prime) mod size; x must be below the prime."""
    return (x * a + b) % prime % size


def trailing_zeros(v: Column) -> Column:
    """Zeros after the last one of the binary form; 3 for 0, whose form '0b0' has no one."""
    return F.when(v == 0, F.lit(3)).otherwise(F.bit_count(v.bitwiseAND(-v) - 1))
