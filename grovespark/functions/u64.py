"""Unsigned 64-bit arithmetic on signed longs, in built-in functions and with ANSI mode on.

A long holds the bit pattern. Sums are made of 32-bit halves and products of
16-bit parts, so that nothing overflows. Values that a formula names several
times are bound once: nested formulas would otherwise grow without bound.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
#: 2^64 divided by the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15


def signed(value: int) -> int:
    """The signed long with the bits of an unsigned number."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def lit64(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def let(values: list[Column], f: Callable[..., Column]) -> Column:
    """``f`` of values that are computed once each, however often ``f`` names them."""
    names = [f"v{i}" for i in range(len(values))]
    one = F.array(F.struct(*[v.cast("long").alias(n) for n, v in zip(names, values, strict=True)]))
    return F.transform(one, lambda s: f(*[s[n] for n in names]))[0]


def _total(*terms: Column) -> Column:
    """The sum modulo 2^64 of a few terms, each of which is named twice."""
    low = reduce(add, [t.bitwiseAND(F.lit(MASK32)) for t in terms])
    high = reduce(add, [F.shiftrightunsigned(t, 32) for t in terms])
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(MASK32)))


def add64(a: Column, b: Column) -> Column:
    return let([a, b], _total)


def _product_terms(x: Column, by: int) -> list[Column]:
    """Three terms whose sum modulo 2^64 is ``x`` times a constant."""
    by &= (1 << 64) - 1
    high, low = by >> 32, by & MASK32
    part = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    # Products of 16 and 32 bits; what lies above bit 63 falls off by the shifts.
    upper = (
        (part[0] * F.lit(high)).bitwiseAND(F.lit(MASK32))
        + F.shiftleft((part[1] * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)
        + (part[2] * F.lit(low)).bitwiseAND(F.lit(MASK32))
        + F.shiftleft((part[3] * F.lit(low)).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return [part[0] * F.lit(low), F.shiftleft(part[1] * F.lit(low), 16), F.shiftleft(upper, 32)]


def mul64(a: Column, by: int) -> Column:
    """``a`` times a constant, modulo 2^64."""
    return let([a], lambda x: let(_product_terms(x, by), _total))


def mix64(seed: Column, value: Column) -> Column:
    """One step of the order-dependent hash that identities and folder hashes are made of."""
    return let([seed, value], lambda s, v: s.bitwiseXOR(_total(v, lit64(GOLDEN), F.shiftleft(s, 6), F.shiftrightunsigned(s, 2))))


def splitmix64(value: Column) -> Column:
    def folded(z: Column, bits: int) -> Column:
        return let([z], lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, bits)))

    z = mul64(folded(add64(value, lit64(GOLDEN)), 30), 0xBF58476D1CE4E5B9)
    return folded(mul64(folded(z, 27), 0x94D049BB133111EB), 31)


def with_splitmix64(df: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with the splitmix64 of a column, a step a projection: compiled, where ``splitmix64`` is interpreted.

    A step names the one before several times, so Spark keeps the steps apart.
    """

    def step(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
        return df.withColumn(name, f(F.col(name)))

    def folded(bits: int) -> Callable[[Column], Column]:
        return lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, bits))

    df = step(df.withColumn(name, F.col(value).cast("long")), lambda z: _total(z, lit64(GOLDEN)))
    for bits, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        df = step(df, folded(bits))
        df = step(df, lambda z, by=by: _total(*_product_terms(z, by)))
    return step(df, folded(31))


def unsigned_key(value: Column) -> Column:
    """Sorts as the unsigned number does."""
    return value.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def unsigned(value: Column) -> Column:
    """The unsigned number, as DECIMAL(20, 0)."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def from_unsigned(value: Column) -> Column:
    """The long of a number from 0 to 2^64-1."""
    low = F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.when(value >= F.lit(str(1 << 63)).cast("decimal(20,0)"), value - low).otherwise(value).cast("long")


def umod(value: Column, by: int) -> Column:
    """The unsigned remainder of a constant below 2^63."""
    if by < 1 << 31:
        high, low = F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(MASK32))
        return (high % F.lit(by) * F.lit((1 << 32) % by) + low) % F.lit(by)
    return (unsigned(value) % F.lit(str(by)).cast("decimal(20,0)")).cast("long")


def sum64(value: Column) -> Column:
    """Aggregate: the sum modulo 2^64. A sum of decimals, so it is partly made before the shuffle."""
    total = F.sum(unsigned(value).cast("decimal(28,0)"))
    rest = (total % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    return from_unsigned(F.coalesce(rest, F.lit(0).cast("decimal(20,0)")))
