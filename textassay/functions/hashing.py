"""FNV-1a as a native column, in two 32-bit limbs: bigint arithmetic must not overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
OFFSET_HIGH, OFFSET_LOW = 0xCBF29CE4, 0x84222325


def fnv1a_mod(text: Column, modulus: int) -> Column:
    """FNV-1a (64 bits) of the UTF-8 bytes, modulo a small number.

    The prime is 2**40 + 435, so that a step is two small products and shifts.
    """
    digits = F.hex(text.cast("binary"))
    count = F.octet_length(text)
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    start = F.struct(F.lit(OFFSET_HIGH).cast("long").alias("hi"), F.lit(OFFSET_LOW).cast("long").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        x = acc["lo"].bitwiseXOR(byte(i))
        product = x * 435
        high = acc["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK32).cast("long")).alias("hi"), product.bitwiseAND(F.lit(MASK32).cast("long")).alias("lo"))

    positions = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    high_unit = (1 << 32) % modulus
    return F.aggregate(positions, start, step, lambda acc: F.pmod(F.pmod(acc["hi"], F.lit(modulus)) * high_unit + F.pmod(acc["lo"], F.lit(modulus)), F.lit(modulus)))
