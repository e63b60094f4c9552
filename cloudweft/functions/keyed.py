"""Repeatable random numbers: a uniform that depends on keys, a seed and a salt, never on partitions or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two lanes of state: a prime below 2^31 each, and factors of cloud, point, seed and salt that keep every sum within BIGINT.
LANES = ((2147483647, 362436069, 521288629, 48271, 104729), (2147483629, 410092949, 123456789, 69621, 130363))


def uniform(cloud: Column, point: Column | int = 0, seed: int = 0, salt: int | Column = 0) -> Column:
    """A number in (0, 1) for a cloud and a point; other salts give independent numbers. Integer arithmetic within BIGINT.

    Cloud and point enter two lanes with other moduli and factors, so keys only share a state if both lanes agree: ids may be of any size,
    and clouds of any number of points. The first lane gives the upper 31 bits, the second the 21 below.
    """
    point = F.lit(point) if isinstance(point, int) else point
    salt = F.lit(salt) if isinstance(salt, int) else salt

    def lane(p: int, a: int, b: int, c: int, d: int) -> Column:
        h = (F.pmod(cloud.cast("long"), F.lit(p)) * a + F.pmod(point.cast("long"), F.lit(p)) * b + seed % p * c) % p
        h = (h * h + h * 12345) % p
        h = (h * 48271 + F.pmod(salt.cast("long"), F.lit(p)) * d) % p
        return (h * h + h * 12345) % p

    high, low = (lane(*v) for v in LANES)
    return (high * 2097152 + F.shiftright(low, 10) + F.lit(0.5)) / F.lit(float(LANES[0][0] * 2097152))


def gaussian(cloud: Column, point: Column | int = 0, seed: int = 0, salt: int = 0) -> Column:
    """A standard normal number by Box-Muller, from salts ``2 * salt`` and ``2 * salt + 1``."""
    u, v = (uniform(cloud, point, seed, 2 * salt + k) for k in (0, 1))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def uniform_sql(cloud: str, point: str = "0", seed: int = 0, salt: int | str = 0) -> str:
    """The same uniform as DuckDB SQL."""

    def lane(p: int, a: int, b: int, c: int, d: int) -> str:
        cl, pt, sa = (f"((({v})::bigint % {p} + {p}) % {p})" for v in (cloud, point, salt))
        h1 = f"({cl} * {a} + {pt} * {b} + {seed % p * c}) % {p}"
        h2 = f"(({h1}) * ({h1}) + ({h1}) * 12345) % {p}"
        h3 = f"(({h2}) * 48271 + {sa} * {d}) % {p}"
        return f"(({h3}) * ({h3}) + ({h3}) * 12345) % {p}"

    high, low = (lane(*v) for v in LANES)
    return f"((({high}) * 2097152 + (({low}) >> 10) + 0.5::double) / {LANES[0][0] * 2097152}.0::double)"


def gaussian_sql(cloud: str, point: str = "0", seed: int = 0, salt: int = 0) -> str:
    u, v = (uniform_sql(cloud, point, seed, 2 * salt + k) for k in (0, 1))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


def rounded(c: Column, digits: int = 6) -> Column:
    """For published floats: rounded, and without negative zero."""
    return F.round(c, digits) + F.lit(0.0)
