"""Reproducible randomness: hashes of keys instead of generators, so that a retry gives the same draw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier, increment and modulus of the arithmetic hash (a linear congruence both SQL engines compute alike).
A, C, M = 48271, 11, 2147483647


def draw(key: Column, seed: int = 0) -> Column:
    """A whole number in [0, 2^31 - 1) for a whole-number key."""
    x = F.pmod(key.cast("bigint") * F.lit(A) + F.lit(C + seed * 7919), F.lit(M))
    return F.pmod(x * F.lit(A) + F.lit(C), F.lit(M))


def uniform(key: Column, seed: int = 0) -> Column:
    return draw(key, seed) / F.lit(float(M))


def text_draw(*keys: Column, seed: int = 0) -> Column:
    """The same for any columns."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(M))


def draw_sql(key: str, seed: int = 0) -> str:
    return f"(((({key})::BIGINT * {A} + {C + seed * 7919}) % {M}) * {A} + {C}) % {M}"


def set_digest(*columns: str) -> Column:
    """A digest of the set of a group's distinct rows: their number, and the exclusive or and the sum of two hashes.

    It does not depend on the order, and partial digests merge, so no task holds the set.
    """
    wide = F.xxhash64(*columns, F.lit(2)).cast("decimal(20,0)")
    return F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns, F.lit(1))).alias("x"), F.sum(wide).alias("s"))
