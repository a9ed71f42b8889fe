"""CRC-32 of a whole from the CRC-32 of its parts.

Checksums are polynomials over two elements, modulo the one of CRC-32: that of A followed by B is the one of A times x^(8 |B|), plus
that of B. So the checksum of a whole is the exclusive or of its parts', each moved by the bytes behind it, and as x has an
inverse, each may be moved back by the bytes up to its own end and the sum moved forward by the length of the
whole: an aggregation that is combined before its shuffle, whatever the order and the number of the parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the polynomial, lowest power in the highest bit. x generates all its non-zero remainders.
POLYNOMIAL, ORDER = 0xEDB88320, (1 << 32) - 1
ONE = 1 << 31


def product(a: int, b: int) -> int:
    """a times b, of Python's integers."""
    out = 0
    for i in reversed(range(32)):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


#: x^(2^k) for k from 0 to 31.
POWERS = [reduce(lambda p, _: product(p, p), range(k), ONE >> 1) for k in range(32)]


def combined(first: int, second: int, bytes_of_second: int) -> int:
    """The checksum of two parts in a row, of Python's integers."""
    return reduce(product, (POWERS[k] for k in range(32) if 8 * bytes_of_second % ORDER >> k & 1), first) ^ second


def _product(a: Column, b: Column) -> Column:
    """As product, of bigint columns."""
    bit = lambda v, i: F.call_function("shiftright", v, i).bitwiseAND(F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("p"), b.alias("b"))

    def step(s: Column, i: Column) -> Column:
        p = F.when(bit(a, i) == 1, s["p"].bitwiseXOR(s["b"])).otherwise(s["p"])
        half = F.shiftright(s["b"], 1)
        return F.struct(p.alias("p"), F.when(s["b"].bitwiseAND(F.lit(1)) == 1, half.bitwiseXOR(F.lit(POLYNOMIAL))).otherwise(half).alias("b"))

    return F.aggregate(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), start, step, lambda s: s["p"])


def moved(crc: Column, byte_count: Column) -> Column:
    """crc times x^(8 * byte_count); a negative count moves back."""
    n = F.pmod(byte_count.cast("long") * 8, F.lit(ORDER))
    powers = F.array(*(F.lit(p) for p in POWERS))
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftright", n, k).bitwiseAND(F.lit(1)) == 1)
    return F.aggregate(bits, crc.cast("long"), lambda c, k: _product(F.get(powers, k), c))


def merged(parts: DataFrame, by: list[str], offset: str, data: str) -> DataFrame:
    """(by, bytes, crc32) of the wholes whose parts lie at `offset` (bytes before them): in any order, without gaps."""
    end = (F.col(offset) + F.octet_length(data)).cast("long")
    sums = parts.where(F.col(data).isNotNull()).select(*by, end.alias("_end"), moved(F.crc32(data), -end).alias("_crc"))
    return sums.groupBy(*by).agg(F.max("_end").alias("bytes"), F.bit_xor("_crc").alias("_crc")).select(*by, "bytes", moved(F.col("_crc"), F.col("bytes")).alias("crc32"))
