"""Token hashes: FNV-1a with the offset basis that the fingerprints are defined by, reduced to 1 .. 1e9 + 6."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASIS, PRIME, MODULUS = 1469598103934665603, 1099511628211, 1_000_000_007
_LOW = 0xFFFFFFFF


def symbol(token: bytes | str) -> int:
    h = BASIS
    for b in token.encode("latin-1") if isinstance(token, str) else token:
        h = ((h ^ b) * PRIME) % (1 << 64)
    return h % (MODULUS - 1) + 1


def symbol_of(token: Column) -> Column:
    """``symbol`` of a column whose characters stand for single bytes.

    The 64-bit state is kept as two halves, so no product leaves BIGINT:
    PRIME is 2 ** 40 + 435, and a shift by 40 moves the low half by 8 into the high one.
    """
    state = F.struct(F.lit(BASIS >> 32).cast("bigint").alias("hi"), F.lit(BASIS & _LOW).cast("bigint").alias("lo"))

    def step(s: Column, byte: Column) -> Column:
        low = s["lo"].bitwiseXOR(byte)
        product = low * 435
        high = (s["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(_LOW))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    def finish(s: Column) -> Column:
        return (s["hi"] * ((1 << 32) % (MODULUS - 1)) + s["lo"]) % (MODULUS - 1) + 1

    codes = F.transform(F.split(token, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), state, step, finish)
