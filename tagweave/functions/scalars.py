"""Scalar values as little-endian bytes and back, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions import varint
from tagweave.functions.binding import bind

#: Wire type codes. Fixed values.
CODES = {
    "null": 0, "bool": 1, "u8": 2, "u16": 3, "u32": 4, "u64": 5, "i8": 6, "i16": 7, "i32": 8, "i64": 9,
    "f32": 10, "f64": 11, "bytes": 12, "string": 13, "array": 14, "object": 15,
}
NAMES = {v: k for k, v in CODES.items()}


@dataclass(frozen=True)
class Scalar:
    """width: bytes; kind: u unsigned, i signed, f float; spark: the column type that holds all its values."""

    width: int
    kind: str
    spark: str


NUMBERS = {
    "u8": Scalar(1, "u", "smallint"), "u16": Scalar(2, "u", "int"), "u32": Scalar(4, "u", "bigint"), "u64": Scalar(8, "u", "decimal(20,0)"),
    "i8": Scalar(1, "i", "tinyint"), "i16": Scalar(2, "i", "smallint"), "i32": Scalar(4, "i", "int"), "i64": Scalar(8, "i", "bigint"),
    "f32": Scalar(4, "f", "float"), "f64": Scalar(8, "f", "double"),
}


def swapped(digits: Column, width: int) -> Column:
    """Hexadecimal digits of `width` bytes in the opposite order of bytes."""
    return bind(digits, lambda d: F.concat(*(F.substring(d, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width))))) if width > 1 else digits


def _bits(value: Column, name: str) -> Column:
    if name == "f64":
        return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double")).cast("long")
    if name == "f32":
        return F.reflect(F.lit("java.lang.Float"), F.lit("floatToIntBits"), value.cast("float")).cast("int").cast("long")
    return varint.bits_of(value) if name == "u64" else value.cast("long")


def encode_hex(value: Column, name: str) -> Column:
    """Hexadecimal digits of a value's bytes; null for null."""
    if name == "null":
        return F.lit("")
    if name == "bool":
        return F.when(value, "01").when(~value, "00")
    if name == "bytes":
        return F.hex(value)
    if name == "string":
        return F.hex(F.encode(value.cast("string"), "UTF-8"))
    if name not in NUMBERS:
        raise ValueError(f"Codec Error: {name} is not a basic value")
    width = NUMBERS[name].width
    return bind(F.lpad(F.hex(_bits(value, name)), 16, "0"), lambda bits: swapped(F.right(bits, F.lit(2 * width)), width))


def encode(value: Column, name: str) -> Column:
    return F.unhex(encode_hex(value, name))


def decode(data: Column, name: str) -> Column:
    """The value of exactly its width of bytes, else null: strict callers check width_ok()."""
    digits = F.hex(data)
    if name == "null":
        return F.lit(None)
    if name == "bool":
        return F.when(width_ok(data, name), digits != "00")
    if name == "bytes":
        return data
    if name == "string":
        return F.try_validate_utf8(data.cast("string"))
    width, kind, spark = NUMBERS[name].width, NUMBERS[name].kind, NUMBERS[name].spark
    raw = F.conv(swapped(digits, width), 16, -10).cast("long")  # as unsigned, but for eight bytes
    return F.when(width_ok(data, name), bind(raw, lambda bits: _of_bits(bits, name, width, kind, spark)))


def _of_bits(bits: Column, name: str, width: int, kind: str, spark: str) -> Column:
    if kind == "u":
        return varint.unsigned(bits) if width == 8 else bits.cast(spark)
    if name == "f64":
        return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")
    span = 1 << (8 * width)
    signed = bits if width == 8 else F.when(bits >= span // 2, bits - span).otherwise(bits)
    return F.reflect(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), signed.cast("int")).cast("float") if name == "f32" else signed.cast(spark)


# -- integers beyond their type ----------------------------------------------------------------------

_NIBBLES = 0x0F0F0F0F0F0F0F0F


def _wider(name: str) -> list[str]:
    """The types of an integer type's kind that are as wide or wider, narrowest first."""
    if name not in NUMBERS or NUMBERS[name].kind == "f":
        raise ValueError(f"Codec Error: {name} is not an integer type")
    return [n for n, s in NUMBERS.items() if s.kind == NUMBERS[name].kind and s.width >= NUMBERS[name].width]


def fitting(low: Column, high: Column, name: str) -> Column:
    """struct<type tinyint, width int> of the narrowest type from `name` on, of its kind, that holds all integers from low to high; an error if none does."""
    types = _wider(name)
    of = lambda n: F.struct(F.lit(CODES[n]).cast("tinyint").alias("type"), F.lit(NUMBERS[n].width).alias("width"))
    out = of(types[-1])
    for n in reversed(types[:-1]):
        bits = 8 * NUMBERS[n].width
        least, most = (0, (1 << bits) - 1) if NUMBERS[n].kind == "u" else (-(1 << bits - 1), (1 << bits - 1) - 1)
        out = F.when(low.isNull() | (low >= least) & (high <= most), of(n)).otherwise(out)
    if NUMBERS[name].kind == "u":
        out = F.when(low < 0, F.raise_error(F.concat(F.lit("Codec Error: "), low.cast("string"), F.lit(f" is out of range for {name}")))).otherwise(out)
    return out


def integer_bits(value: Column, name: str) -> Column:
    """An integer's bits as a long: those of a DECIMAL over 2^63 too, where the type is u64."""
    _wider(name)
    return _bits(value, name)


def _bytes_turned(bits: Column) -> Column:
    """A long whose hexadecimal digits, read from the end, are its bytes from the low one."""
    mask = F.lit(_NIBBLES)
    return F.shiftleft(bits.bitwiseAND(mask), 4).bitwiseOR(F.shiftrightunsigned(bits, 4).bitwiseAND(mask))


def low_bytes_hex(bits: Column, width: Column) -> Column:
    """Digits of as many of a long's bytes, from the low one."""
    return F.left(F.reverse(F.lpad(F.hex(_bytes_turned(bits)), 16, "0")), 2 * width)


def encode_fitting(value: Column, name: str) -> Column:
    """encode(), but an integer that `name` doesn't hold is written in the next wider type that does, and none is cut."""
    return F.unhex(low_bytes_hex(integer_bits(value, name), fitting(value, value, name)["width"]))


def decode_fitting(data: Column, name: str) -> Column:
    """What encode_fitting() wrote, as BIGINT or, unsigned, DECIMAL(20,0): the number of bytes tells the type. Null for another number of bytes."""
    known = F.when(F.octet_length(data).isin([NUMBERS[n].width for n in _wider(name)]), data)
    turned = F.conv(F.reverse(F.rpad(F.hex(known), 16, "0")), 16, -10).cast("long")
    bits = _bytes_turned(turned)
    if NUMBERS[name].kind == "u":
        return varint.unsigned(bits)
    unused = 64 - 8 * F.octet_length(known)
    return F.call_function("shiftright", F.call_function("shiftleft", bits, unused), unused)


def width_ok(data: Column, name: str) -> Column:
    if name in ("bytes", "string"):
        return data.isNotNull()
    width = {"null": 0, "bool": 1}.get(name) if name in ("null", "bool") else NUMBERS[name].width
    return F.octet_length(data) == width
