"""Deterministic pseudo-random draws per row.

A draw is a function of a row's key and a salt only. It does not depend on
partitioning, so a lost task recomputes the same values, and any SQL engine with
64-bit integers can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2^31 - 1 is prime, and x -> x^5 permutes the residues because 5 is coprime to
# 2^31 - 2. Every product below stays under 2^63.
MODULUS = 2147483647


def draw(key: Column, salt: int) -> Column:
    """BIGINT in [0, MODULUS) for a non-negative BIGINT key."""
    multiplier = 48271 + 1000003 * salt
    high_bits = F.shiftright(key, 31) * 69621
    x = (key % MODULUS * multiplier + high_bits + 12345 + salt) % MODULUS
    square = x * x % MODULUS
    return square * square % MODULUS * x % MODULUS


def draw_below(key: Column, salt: int, limit: int) -> Column:
    """Uniform BIGINT in [0, limit)."""
    return draw(key, salt) % limit


def draw_one(key: Column, salt: int, choices: tuple[str, ...]) -> Column:
    """Uniform pick from a short list."""
    options = F.array(*[F.lit(c) for c in choices])
    return F.element_at(options, (draw_below(key, salt, len(choices)) + 1).cast("int"))


def hits(key: Column, salt: int, fraction: float) -> Column:
    """True for about ``fraction`` of the keys."""
    return draw(key, salt) < round(fraction * MODULUS)
