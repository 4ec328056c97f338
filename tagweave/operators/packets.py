"""Packets: header (varints of schema, time and shard; flags; body type), body, BLAKE3 checksum of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagweave.functions import scalars, varint, vector
from tagweave.functions.blake3 import blake3, digests
from tagweave.operators import codec

RAW, COMPRESSED, ENCRYPTED = 0, 1, 2
STRATEGIES = {"none": 0, "zstd": 1, "brotli": 3}
CHECKSUM = 32


def encode_header(schema_id: Column, timestamp: Column, shard_id: Column, flow_flags: Column, body_type: Column) -> Column:
    """BINARY header; numbers are longs that stand for unsigned bits."""
    numbers = [varint.encode_hex(c) for c in (schema_id, timestamp, shard_id)]
    return F.unhex(F.concat(*numbers, scalars.encode_hex(flow_flags.cast("long"), "u32"), varint.byte_hex(body_type.cast("long"))))


_HEADER = T.StructType(
    [*(T.StructField(n, T.LongType()) for n in ("schema_id", "timestamp", "shard_id", "flow_flags")), T.StructField("body_type", T.IntegerType()), T.StructField("read", T.IntegerType()), T.StructField("error", T.StringType())]
)
_NUMBERS = ("schema_id", "timestamp", "shard_id")


def read_headers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's header: fields by name, with whether they could be read, where it ends, what is wrong, and whether its varints are as short as can be."""
    n = len(start)
    fields, at, error, shortest = {}, start, np.full(n, None, object), np.ones(n, bool)
    for name in _NUMBERS:
        good = error == None  # noqa: E711
        before = np.where(good, at, end)
        value, at, status = vector.varints(data, before, end)
        error[good & (status == vector.INCOMPLETE)] = "Incomplete varint data"
        error[good & (status == vector.TOO_LARGE)] = "Varint value too large"
        size = at - before
        low = np.where(size > 1, np.uint64(1) << np.minimum(7 * (size - 1), 63).astype(np.uint64), np.uint64(0))
        shortest &= (value >= low) & (size < 10)
        fields[name] = value.view(np.int64), good & (status == vector.READ)
    for name, kind in (("flow_flags", np.dtype("<u4")), ("body_type", np.dtype("u1"))):
        good = error == None  # noqa: E711
        has = good & (at + kind.itemsize <= end)
        error[good & ~has] = f"Incomplete data for {name}"
        fields[name] = vector.numbers(data, np.where(has, at, 0), kind).astype(np.int64), has
        at = np.where(has, at + kind.itemsize, at)
    kind, has = fields["body_type"]
    for i in np.flatnonzero(has & (kind > ENCRYPTED)):
        error[i] = f"Unknown DataBodyType value: {kind[i]}"
    return fields, at, error, shortest


def decode_header(data: Column) -> Column:
    """struct<schema_id, timestamp, shard_id, flow_flags, body_type, read, error> of the header that BINARY begins with."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(_HEADER)
        for batch in batches:
            raw, start, end, valid = vector.spans(batch)
            fields, at, error, _ = read_headers(raw, start, end)
            columns = [pa.array(value, mask=~(has & valid)).cast(kind.field(name).type) for name, (value, has) in fields.items()]
            columns.append(pa.array((at - start).astype(np.int32), mask=~fields["body_type"][1]))
            columns.append(pa.array(error, pa.string()))
            yield pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array(~valid))

    return F.arrow_udf(run, _HEADER)(data)


def strategy_of(flow_flags: Column) -> Column:
    """none, zstd or brotli, by the low two bits; null for 2, which stands for none of them."""
    low = flow_flags.bitwiseAND(F.lit(3))
    return F.when(low == 0, "none").when(low == 1, "zstd").when(low == 3, "brotli")


def strategy_error(flow_flags: Column) -> Column:
    """What is wrong with the low two bits; null if they name a strategy."""
    low = flow_flags.bitwiseAND(F.lit(3))
    return F.when(low == 2, F.concat(F.lit("Codec Error: Unknown compression strategy bits in flow_flags: "), low.cast("string")))


def known_strategy_of(flow_flags: Column) -> Column:
    """strategy_of(), which raises strategy_error() where there is one."""
    error = strategy_error(flow_flags)
    return F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(strategy_of(flow_flags))


def with_strategy(flow_flags: Column, strategy: str) -> Column:
    return flow_flags.bitwiseAND(F.lit(0xFFFFFFFC)).bitwiseOR(F.lit(STRATEGIES[strategy]))


def build(schema_id: Column, timestamp: Column, shard_id: Column, flow_flags: Column, body_type: Column, body: Column) -> Column:
    """BINARY packet."""
    signed = F.concat(encode_header(schema_id, timestamp, shard_id, flow_flags, body_type), body)
    return F.concat(signed, blake3(signed))


VARIANTS = {"raw": RAW, "compressed": COMPRESSED, "encrypted": ENCRYPTED}


def build_variant(schema_id: Column, timestamp: Column, shard_id: Column, flow_flags: Column, variant: Column, body: Column) -> Column:
    """BINARY packet of a body that is raw, compressed or encrypted, as variant says; the header's body type follows from it."""
    known = F.when(variant == "raw", RAW).when(variant == "compressed", COMPRESSED).when(variant == "encrypted", ENCRYPTED)
    kind = F.coalesce(known, F.raise_error(F.concat(F.lit("Codec Error: Unknown body variant: "), F.coalesce(variant, F.lit("null")))).cast("int"))
    return build(schema_id, timestamp, shard_id, flow_flags, kind, body)


_CHECKED = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("schema_id", "timestamp", "shard_id", "flow_flags")),
        T.StructField("body_type", T.IntegerType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_packet(data: bytes) -> tuple[tuple[int, int, int, int, int], bytes, bytes, bytes]:
    """Header fields, the header as it would be encoded anew, body and checksum."""
    numbers, at = [], 0
    for _ in range(3):
        value, at = codec.read_varint(data, at)
        numbers.append(value)
    for name, size in (("flow_flags", 4), ("body_type", 1)):
        if len(data) < at + size:
            raise codec.CodecError(f"Incomplete data for {name}")
        numbers.append(int.from_bytes(data[at : at + size], "little"))
        at += size
    if numbers[4] > ENCRYPTED:
        raise codec.CodecError(f"Unknown DataBodyType value: {numbers[4]}")
    if len(data) - at < CHECKSUM:
        raise codec.CodecError("Incomplete data for Checksum")
    head = b"".join(map(codec.write_varint, numbers[:3])) + numbers[3].to_bytes(4, "little") + bytes([numbers[4]])
    return tuple(numbers), head, data[at : len(data) - CHECKSUM], data[len(data) - CHECKSUM :]


def _verify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = to_arrow_type(_CHECKED)
    for batch in batches:
        raw, start, end, valid = vector.spans(batch)
        fields, at, error, shortest = read_headers(raw, start, end)
        short = (error == None) & (end - at < CHECKSUM)  # noqa: E711
        error[short] = "Incomplete data for Checksum"
        known = {name: has & (error == None) for name, (_, has) in fields.items()}  # noqa: E711
        good = np.flatnonzero(valid & (error == None))  # noqa: E711
        # a header of overlong varints is checked as it would be encoded anew
        signed = [raw[start[i] : end[i] - CHECKSUM].tobytes() if shortest[i] else b"".join(read_packet(raw[start[i] : end[i]].tobytes())[1:3]) for i in good]
        sums = np.frombuffer(b"".join(digests(signed)), np.uint8).reshape(-1, CHECKSUM)
        wrong = good[(sums != raw[(end[good] - CHECKSUM)[:, None] + np.arange(CHECKSUM)]).any(1)]
        error[wrong] = "Checksum verification failed"
        open_ = valid & (error == None)  # noqa: E711
        columns = [pa.array(value, mask=~(known[name] & valid)).cast(kind.field(name).type) for name, (value, _) in fields.items()]
        columns += [vector.pieces(raw, np.where(open_, at, 0), end - CHECKSUM - at, open_), pa.array(error, pa.string())]
        yield pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array(~valid))


def check(data: Column) -> Column:
    """struct<schema_id, timestamp, shard_id, flow_flags, body_type, body, error> of a packet. The checksum is over the header as it would be encoded anew, and the body."""
    return F.arrow_udf(_verify, _CHECKED)(data)


def verified(df: DataFrame, packet: str) -> DataFrame:
    """df with the fields of check() as columns."""
    return df.withColumn("_checked", check(F.col(packet))).select("*", "_checked.*").drop("_checked")
