"""Random numbers that depend on a seed and row keys only.

Every draw is a hash of its arguments, so a rerun after a lost executor, another
partitioning or another order of rows gives the same numbers. The hash is whole-number
arithmetic modulo a prime: parts are taken in one by one, each followed by a fifth
power, which permutes the numbers below this prime. Any engine with 64-bit integers can
repeat it; ``plans.draws_sql`` writes it in SQL.

Parts are texts and numbers known beforehand (tags), which cost nothing per row, and
columns: whole numbers, or of any other type by their hash.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.arrays import let

PRIME, FACTOR, SHIFT = 2_147_483_647, 48_271, 1_013_904_223

Part = Column | str | int


def known(part: str | int) -> int:
    """Number of a tag."""
    return (zlib.crc32(part.encode()) if isinstance(part, str) else part) % PRIME


def fold_known(h: int, part: int) -> int:
    return (pow((h * FACTOR + part) % PRIME, 5, PRIME) + SHIFT) % PRIME


def split_known(seed: int, parts: tuple) -> tuple[int, tuple]:
    """The hash of the seed and the tags that lead, and the parts from the first column on."""
    n = next((i for i, p in enumerate(parts) if not isinstance(p, (str, int))), len(parts))
    return reduce(fold_known, map(known, parts[:n]), fold_known(0, seed % PRIME)), parts[n:]


def _number(part: Part) -> Column:
    if isinstance(part, (str, int)):
        return F.lit(known(part)).cast("long")
    whole = F.coalesce(part.try_cast("long"), F.xxhash64(part))
    # numbers that are equal modulo the prime differ by their quotient
    return let(whole, lambda v: F.pmod(v + F.pmod(F.floor(v / PRIME), F.lit(1 << 20)) * F.lit(7919), F.lit(PRIME).cast("long")))


def _fold(h: Column, part: Column) -> Column:
    p = F.lit(PRIME).cast("long")
    fifth = lambda x: let(x * x % p, lambda x2: (x2 * x2 % p) * x % p)
    return let((h * F.lit(FACTOR).cast("long") + part) % p, lambda x: (fifth(x) + F.lit(SHIFT).cast("long")) % p)


def cell(seed: int, *parts: Part) -> Column:
    """Whole number in [0, PRIME), evenly spread."""
    start, rest = split_known(seed, parts)
    return reduce(_fold, map(_number, rest), F.lit(start).cast("long"))


def uniform(seed: int, *parts: Part) -> Column:
    """Uniform in (0, 1)."""
    return (cell(seed, *parts).cast("double") + 0.5) / float(PRIME)


def normal(seed: int, *parts: Part) -> Column:
    """Standard normal from two independent hashes (Box-Muller)."""
    u, v = uniform(seed, "r", *parts), uniform(seed, "a", *parts)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def integer(low: int, high: int | Column, seed: int, *parts: Part) -> Column:
    """Integer in [low, high)."""
    top = F.lit(high) if isinstance(high, int) else high
    return (F.floor(uniform(seed, *parts) * (top - F.lit(low))) + F.lit(low)).cast("long")
