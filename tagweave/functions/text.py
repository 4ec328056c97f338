"""Functions on bytes: NUL scan, character count, content sniffing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_nul(data: Column) -> Column:
    """Whether BINARY holds a zero byte. Pairs of digits are matched from the start, as 00 may straddle two bytes."""
    return F.hex(data).rlike("^(?:..)*?00")


def utf8_length(data: Column) -> Column:
    """Code points of BINARY; null where it isn't UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), F.char_length(data.cast("string"))).cast("long")


def sniff(data: Column, sample: int = 1024) -> Column:
    """Numeric, Text, Binary or Unknown, by the bytes of the first `sample`: digits, other printable or white space, the rest."""
    head = F.hex(F.substring(data, F.lit(1), F.lit(sample)))
    total = F.length(head) / 2
    digits = _count(head, "3[0-9]")
    printable = _count(head, "(?:[2-7][0-9A-F]|09|0A|0D)") - _count(head, "7F") - digits
    other = total - digits - printable
    return (
        F.when(total == 0, "Unknown").when((digits > printable) & (digits > other), "Numeric").when(printable > other, "Text").when(total.isNotNull(), "Binary")
    )


def _count(digits: Column, byte: str) -> Column:
    """Bytes, as pairs of hexadecimal digits, that match. Pairs that don't are stepped over by the other branch."""
    kept = F.regexp_replace(digits, f"({byte})|..", "$1")
    return F.length(kept) / 2


def strategy_for(kind: Column, latency_ms: Column, bandwidth_mbps: Column, default: str = "zstd") -> Column:
    """The compression for a kind of data: zstd, brotli or none."""
    binary = F.when(latency_ms < 10, "none").when(bandwidth_mbps > 100, "zstd").otherwise("brotli")
    return F.when(kind == "Numeric", "zstd").when(kind == "Text", "brotli").when(kind == "Binary", binary).otherwise(default)
