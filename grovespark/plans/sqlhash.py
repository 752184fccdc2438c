"""SQL for DuckDB of 64-bit hashes: chains of common table expressions over unsigned numbers."""

from __future__ import annotations

M64 = "18446744073709551616::UHUGEINT"
#: The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def mul(a: str, by: int) -> str:
    return f"(({a})::UHUGEINT * {by}::UHUGEINT % {M64})::UBIGINT"


def add(*terms: str) -> str:
    return f"(({' + '.join(f'({t})::UHUGEINT' for t in terms)}) % {M64})::UBIGINT"


def rotl(a: str, bits: int) -> str:
    return add(f"({a})::UHUGEINT * {1 << bits}::UHUGEINT % {M64}", f"({a}) >> {64 - bits}")


def lane(x: str, at: str, size: int) -> str:
    """``size`` bytes from byte ``at`` on of a text in hexadecimal, as a little-endian number."""
    parts = " || ".join(f"substr({x}, CAST(2 * (({at}) + {i}) + 1 AS BIGINT), 2)" for i in reversed(range(size)))
    return f"CAST('0x' || {parts} AS UBIGINT)"


def round_of(acc: str, value: str) -> str:
    return mul(rotl(add(acc, mul(value, P2)), 31), P1)


def xxh64(name: str, source: str, keys: str, x: str) -> str:
    """CTEs that end in ``name`` (``keys``, h): XXH64 with seed 0 of ``x``, a text in hexadecimal, in ``source``."""
    each = ", ".join(
        f"list_transform(range(0, s), lambda i: {lane('x', f'32 * i + {8 * k}', 8)}) AS l{k}" for k in range(4)
    )
    start = (add(str(P1), str(P2)), f"{P2}::UBIGINT", "0::UBIGINT", f"{(1 << 64) - P1}::UBIGINT")
    folded = ", ".join(f"list_reduce(list_prepend({start[k]}, l{k}), lambda a, v: {round_of('a', 'v')}) AS v{k}" for k in range(4))
    out = [
        f"{name}_0 AS (SELECT {keys}, {x} AS x, CAST(length({x}) // 2 AS BIGINT) AS n, CAST(length({x}) // 64 AS BIGINT) AS s FROM {source})",
        f"{name}_1 AS (SELECT {keys}, x, n, s, {each} FROM {name}_0)",
        f"{name}_2 AS (SELECT {keys}, x, n, s, {folded} FROM {name}_1)",
        f"{name}_3 AS (SELECT *, {add(rotl('v0', 1), rotl('v1', 7), rotl('v2', 12), rotl('v3', 18))} AS h FROM {name}_2)",
    ]
    for k in range(4):
        merged = add(mul(f"xor(h, {round_of('0::UBIGINT', f'v{k}')})", P1), str(P4))
        out.append(f"{name}_{4 + k} AS (SELECT * REPLACE ({merged} AS h) FROM {name}_{3 + k})")
    out.append(f"{name}_8 AS (SELECT {keys}, x, n, {add(f'CASE WHEN s > 0 THEN h ELSE {P5}::UBIGINT END', 'n')} AS h, 32 * s AS pos FROM {name}_7)")
    number = 8

    def step(size: int, value: str) -> None:
        nonlocal number
        found = f"{name}_{number}"
        out.append(f"{name}_{number + 1} AS (SELECT {keys}, x, n, CASE WHEN n - pos >= {size} THEN {value} ELSE h END AS h, CASE WHEN n - pos >= {size} THEN pos + {size} ELSE pos END AS pos FROM {found})")
        number += 1

    # A lane beyond the end is not looked at.
    def tail(size: int) -> str:
        return f"CASE WHEN n - pos >= {size} THEN {lane('x', 'pos', size)} ELSE 0::UBIGINT END"

    for _ in range(3):
        step(8, add(mul(rotl(f"xor(h, {round_of('0::UBIGINT', tail(8))})", 27), P1), str(P4)))
    step(4, add(mul(rotl(f"xor(h, {mul(tail(4), P1)})", 23), P2), str(P3)))
    for _ in range(3):
        step(1, mul(rotl(f"xor(h, {mul(tail(1), P5)})", 11), P1))
    out += [
        f"{name}_a AS (SELECT {keys}, {mul('xor(h, h >> 33)', P2)} AS h FROM {name}_{number})",
        f"{name}_b AS (SELECT {keys}, {mul('xor(h, h >> 29)', P3)} AS h FROM {name}_a)",
        f"{name} AS (SELECT {keys}, xor(h, h >> 32) AS h FROM {name}_b)",
    ]
    return ",\n".join(out)


def splitmix64(name: str, source: str, keys: str, value: str) -> str:
    """CTEs that end in ``name`` (``keys``, z): the splitmix64 of ``value`` in ``source``."""
    return ",\n".join(
        [
            f"{name}_0 AS (SELECT {keys}, {add(value, str(0x9E3779B97F4A7C15))} AS z FROM {source})",
            f"{name}_1 AS (SELECT {keys}, {mul('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)} AS z FROM {name}_0)",
            f"{name}_2 AS (SELECT {keys}, {mul('xor(z, z >> 27)', 0x94D049BB133111EB)} AS z FROM {name}_1)",
            f"{name} AS (SELECT {keys}, xor(z, z >> 31) AS z FROM {name}_2)",
        ]
    )


def signed(value: str) -> str:
    return f"CAST(CASE WHEN {value} >= 9223372036854775808 THEN {value}::HUGEINT - 18446744073709551616::HUGEINT ELSE {value}::HUGEINT END AS BIGINT)"
