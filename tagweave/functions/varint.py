"""LEB128 numbers as Column expressions: seven bits a byte, least significant first, at most ten bytes.

Everything is unrolled over the ten possible bytes of a bound value. Numbers are unsigned 64-bit: a long stands for its bits, DECIMAL(20,0) holds all values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.binding import bind

U64 = "decimal(20,0)"
_HALF, _WHOLE = "9223372036854775808", "18446744073709551616"


def bits_of(value: Column) -> Column:
    """DECIMAL(20,0) from 0 to 2^64 - 1 as the long with the same bits."""
    wide = value.cast("decimal(38,0)")
    return F.when(wide >= F.lit(_HALF).cast("decimal(38,0)"), wide - F.lit(_WHOLE).cast("decimal(38,0)")).otherwise(wide).cast("long")


def unsigned(bits: Column) -> Column:
    """The unsigned number that a long's bits are, as DECIMAL(20,0)."""
    wide = bits.cast("decimal(38,0)")
    return F.when(bits < 0, wide + F.lit(_WHOLE).cast("decimal(38,0)")).otherwise(wide).cast(U64)


def byte_hex(value: Column) -> Column:
    """Two hexadecimal digits of a number from 0 to 255."""
    return F.lpad(F.hex(value), 2, "0")


def literal_hex(value: int) -> str:
    """Hexadecimal digits of a known number's varint."""
    out = ""
    while value > 127:
        out += f"{value & 127 | 128:02X}"
        value >>= 7
    return out + f"{value:02X}"


def encode_hex(bits: Column | int) -> Column:
    if isinstance(bits, int):
        return F.lit(literal_hex(bits))

    def unrolled(x: Column) -> Column:
        out = []
        for i in range(10):
            here = F.shiftrightunsigned(x, 7 * i) if i else x
            more = (F.shiftrightunsigned(x, 7 * (i + 1)) != 0) if i < 9 else F.lit(False)
            byte = byte_hex(here.bitwiseAND(F.lit(127)) + F.when(more, 128).otherwise(0))
            out.append(byte if not i else F.when(here != 0, byte).otherwise(""))
        return F.when((x >= 0) & (x < 128), byte_hex(x)).otherwise(F.concat(*out))

    return bind(bits.cast("long"), unrolled)


def encode(bits: Column) -> Column:
    """BINARY varint of a long's bits; use bits_of() for DECIMAL(20,0). Null gives null."""
    return F.unhex(encode_hex(bits))


def byte_at(data: Column, position: Column | int) -> Column:
    """The byte at a position from 1, as a long; null past the end. data: BINARY."""
    return F.conv(F.nullif(F.hex(F.substring(data, F.lit(position) if isinstance(position, int) else position, F.lit(1))), F.lit("")), 16, 10).cast("long")


def decode(data: Column, position: Column | int = 1) -> Column:
    """struct<bits long, read int, error string> of the varint that begins at a position from 1.

    An unfinished varint reads "Incomplete varint data", one whose tenth byte goes on "Varint value too
    large". Overlong forms are accepted, and bits above 64 are lost.
    """
    at = F.lit(position) if isinstance(position, int) else position

    def measured(digits: Column) -> Column:
        last = F.lit(None).cast("int")
        for i in reversed(range(10)):
            byte = F.substring(digits, F.lit(2 * i + 1), F.lit(1))
            last = F.when(F.length(digits) <= 2 * i, F.lit(None).cast("int")).when(byte < "8", F.lit(i + 1)).otherwise(last)
        return F.struct(digits.alias("digits"), last.alias("read"))

    def valued(x: Column) -> Column:
        digits, read = x["digits"], x["read"]
        value = F.lit(0).cast("long")
        for i in range(10):
            byte = F.conv(F.substring(digits, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("long")
            value = value.bitwiseOR(F.when(F.lit(i) < read, F.shiftleft(byte.bitwiseAND(F.lit(127)), 7 * i)).otherwise(F.lit(0).cast("long")))
        error = F.when(read.isNotNull() | digits.isNull(), F.lit(None).cast("string")).when(F.length(digits) >= 20, F.lit("Varint value too large")).otherwise(F.lit("Incomplete varint data"))
        return F.struct(F.when(read.isNotNull(), value).alias("bits"), read.alias("read"), error.alias("error"))

    return bind(bind(F.hex(F.substring(data, at, F.lit(10))), measured), valued)
