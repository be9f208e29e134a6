"""64-bit FNV-1a hash and a 64-bit digit generator as native Spark expressions.

Spark has no unsigned 64-bit type and, with ANSI mode on, an overflowing
multiplication is an error.  The hash is held as ``struct<hi, lo>`` of two
32-bit limbs and the generator as four 16-bit limbs, so that no intermediate
leaves the signed 64-bit range and everything stays on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

MASK16 = 0xFFFF
MASK32 = 0xFFFFFFFF
TWO32 = 1 << 32


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a string as ``array<int>`` (empty for the empty string)."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    chars = F.filter(F.split(latin, ""), lambda c: c != "")
    return F.transform(chars, F.ascii)


def fnv1a64(text: Column, salt: Column | int = 0) -> Column:
    """FNV-1a 64 of the UTF-8 bytes, with ``salt`` (below 2**31) added to the basis."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    start = F.struct(
        F.lit(fv.FNV_OFFSET_HI).cast("bigint").alias("hi"),
        (F.lit(fv.FNV_OFFSET_LO).cast("bigint") + salt.cast("bigint")).alias("lo"),
    )

    def step(acc: Column, byte: Column) -> Column:
        def multiply(x: Column) -> Column:
            low = x * fv.FNV_PRIME_LOW
            high = (
                acc["hi"] * fv.FNV_PRIME_LOW
                + F.shiftright(low, 32)
                + F.shiftleft(x, 8)
            )
            return F.struct(
                high.bitwiseAND(F.lit(MASK32)).alias("hi"),
                low.bitwiseAND(F.lit(MASK32)).alias("lo"),
            )

        return let(acc["lo"].bitwiseXOR(byte.cast("bigint")), multiply)

    return F.aggregate(utf8_bytes(text), start, step)


def unsigned_mod(h: Column, n: int) -> Column:
    """``h % n`` of an unsigned 64-bit value held as limbs (n below 2**31)."""
    return ((h["hi"] % n) * (TWO32 % n) + h["lo"] % n) % n


def times_fnv_prime(h: Column) -> Column:
    """One more multiplication of the hash by the FNV prime."""
    low = h["lo"] * fv.FNV_PRIME_LOW
    high = h["hi"] * fv.FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(h["lo"], 8)
    return F.struct(
        high.bitwiseAND(F.lit(MASK32)).alias("hi"),
        low.bitwiseAND(F.lit(MASK32)).alias("lo"),
    )


def hex_digits(value: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), width, "0")


def low48_hex(h: Column) -> Column:
    """The low 48 bits as 12 hex digits."""
    return F.concat(
        hex_digits(h["hi"].bitwiseAND(F.lit(MASK16)), 4), hex_digits(h["lo"], 8)
    )


def hash_hex(h: Column) -> Column:
    """All 64 bits as 16 hex digits."""
    return F.concat(hex_digits(h["hi"], 8), hex_digits(h["lo"], 8))


def _limbs16(value: int) -> list[int]:
    return [(value >> (16 * i)) & MASK16 for i in range(4)]


def generated_digits(h: Column, n: int) -> Column:
    """``n`` decimal digits from a linear congruential generator seeded with ``h | 1``."""
    a = _limbs16(fv.LCG_MULTIPLIER)
    c = _limbs16(fv.LCG_INCREMENT)
    start = F.struct(
        h["lo"].bitwiseAND(F.lit(MASK16)).bitwiseOR(F.lit(1).cast("bigint")).alias("x0"),
        F.shiftright(h["lo"], 16).alias("x1"),
        h["hi"].bitwiseAND(F.lit(MASK16)).alias("x2"),
        F.shiftright(h["hi"], 16).alias("x3"),
        F.lit("").alias("digits"),
    )

    def step(acc: Column, _: Column) -> Column:
        x = [acc[f"x{i}"] for i in range(4)]
        # Column sums of the schoolbook product; each stays far below 2**63.
        sums = [
            sum((x[j] * a[i - j] for j in range(i + 1)), F.lit(c[i]).cast("bigint"))
            for i in range(4)
        ]

        def carry(s: Column) -> Column:
            r0 = s[0]
            r1 = s[1] + F.shiftright(r0, 16)
            r2 = s[2] + F.shiftright(r1, 16)
            r3 = s[3] + F.shiftright(r2, 16)
            return let(
                F.array(*(r.bitwiseAND(F.lit(MASK16)) for r in (r0, r1, r2, r3))),
                lambda y: F.struct(
                    *(y[i].alias(f"x{i}") for i in range(4)),
                    F.concat(
                        acc["digits"],
                        (F.shiftright(y[3] * 65536 + y[2], 1) % 10).cast("string"),
                    ).alias("digits"),
                ),
            )

        return let(F.array(*sums), carry)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(n)), start, step, lambda acc: acc["digits"]
    )
