"""Compression of binary columns: whole values, shards as parallel rows, the sharded wire form, and contexts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.errors import CompressionError

CODES = {"none": 0, "zstd": 1, "brotli": 3}
NAMES = {v: k for k, v in CODES.items()}
SHARD = 1 << 20
DICTIONARY = 64 * 1024


class _Identity:
    @staticmethod
    def compress(data: bytes) -> bytes:
        return data

    decompress = compress


class _Zstd:
    def __init__(self):
        import zstandard

        self._zstd = zstandard
        self._out = zstandard.ZstdCompressor()

    def compress(self, data: bytes) -> bytes:
        return self._out.compress(data)

    def decompress(self, data: bytes) -> bytes:
        """Reads frames whether or not they state their size."""
        try:
            reader = self._zstd.ZstdDecompressor().decompressobj()
            out = reader.decompress(data)
        except self._zstd.ZstdError as e:
            raise CompressionError(f"zstd: {e}") from None
        if not reader.eof:
            raise CompressionError("zstd: incomplete frame")
        return out


class _Brotli:
    def __init__(self):
        try:
            import brotli
        except ImportError:
            raise CompressionError("brotli needs the brotli package, which is not installed") from None
        self._brotli = brotli

    def compress(self, data: bytes) -> bytes:
        return self._brotli.compress(data, quality=11, lgwin=22)

    def decompress(self, data: bytes) -> bytes:
        try:
            return self._brotli.decompress(data)
        except self._brotli.error as e:
            raise CompressionError(f"brotli: {e}") from None


def codec(strategy: str):
    """The compressor of a strategy, for use in one thread."""
    if strategy not in CODES:
        raise CompressionError(f"Unknown compression strategy: {strategy}")
    return {"none": _Identity, "zstd": _Zstd, "brotli": _Brotli}[strategy]()


def _mapped(strategy: str, method: str, on_error: str = "fail"):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        act = getattr(codec(strategy), method)
        for batch in batches:
            rows = []
            for x in batch:
                try:
                    rows.append(act(x.as_py()) if x.is_valid else None)
                except CompressionError:
                    if on_error == "fail":
                        raise
                    rows.append(None)
            yield pa.array(rows, pa.binary())

    return F.arrow_udf(run, T.BinaryType())


def compress(data: Column, strategy: str = "zstd") -> Column:
    """BINARY compressed; "none" stays within the JVM."""
    if strategy == "brotli":
        codec(strategy)
    return data if strategy == "none" else _mapped(strategy, "compress")(data)


def decompress(data: Column, strategy: str = "zstd", on_error: str = "fail") -> Column:
    """on_error: "fail", or "null" for data that can't be read."""
    if strategy == "brotli":
        codec(strategy)
    return data if strategy == "none" else _mapped(strategy, "decompress", on_error)(data)


# -- shards as rows --------------------------------------------------------------------------------


def to_shards(df: DataFrame, data: str, size: int = SHARD, strategy: str = "zstd", keep_empty: bool = False) -> DataFrame:
    """A row for each shard of each value: the other columns, shard_index, strategy, original_size, compressed_size, shard.

    Shards are rows before they are compressed, so a large value is compressed by many tasks. Empty and
    null values have none; with keep_empty they have a row without a shard, of original size 0 or null.
    """
    value = F.col(data)
    cut = F.transform(F.sequence(F.lit(1), F.octet_length(value), F.lit(size)), lambda i: F.substring(value, i, F.lit(size)))
    rest = [c for c in df.columns if c != data]
    if keep_empty:
        rows = df.select(*rest, F.posexplode_outer(F.when(F.octet_length(value) > 0, cut)).alias("shard_index", "_piece"), F.octet_length(value).alias("_whole"))
        rows = rows.withColumn("_piece", F.when(F.col("_whole") > 0, F.col("_piece")).when(F.col("_whole") == 0, F.lit(b""))).drop("_whole")
    else:
        rows = df.where(F.octet_length(value) > 0).select(*rest, F.posexplode(cut).alias("shard_index", "_piece"))
    packed = rows.withColumn("shard", compress(F.when(F.col("shard_index").isNotNull(), F.col("_piece")), strategy))
    return packed.select(*rest, "shard_index", F.lit(CODES[strategy]).cast("tinyint").alias("strategy"), F.octet_length("_piece").alias("original_size"), F.octet_length("shard").alias("compressed_size"), "shard")


def from_shards(shards: DataFrame, keys: list[str], data: str = "data", strategy: str = "zstd") -> DataFrame:
    """The values, by key columns, from to_shards() rows. A shard of another size than it states raises "Decompressed size mismatch"."""
    whole = shards.withColumn("_piece", decompress(F.col("shard"), strategy))
    sound = F.when(F.col("shard_index").isNull(), F.lit("")).when(F.octet_length("_piece") == F.col("original_size"), F.hex("_piece")).otherwise(F.raise_error(F.lit("Compression Error: Decompressed size mismatch")))
    parts = F.array_sort(F.collect_list(F.struct("shard_index", sound.alias("digits"))))
    value = F.unhex(F.array_join(F.transform(parts, lambda p: p["digits"]), ""))
    return whole.groupBy(*keys).agg(F.when(F.count("original_size") > 0, value).alias(data))


# -- the sharded wire form -------------------------------------------------------------------------


def write_shards(data: bytes, size: int, strategy: str, act=None) -> bytes:
    """Count in four bytes, then for each shard strategy, both sizes in four bytes each, and data. Empty for empty."""
    act = act or codec(strategy).compress
    pieces = [data[i : i + size] for i in range(0, len(data), size)]
    out = [len(pieces).to_bytes(4, "little")] if pieces else []
    for p in pieces:
        packed = act(p)
        out += [bytes([CODES[strategy]]), len(p).to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed]
    return b"".join(out)


def read_shards(data: bytes) -> bytes:
    if not data:
        return b""
    if len(data) < 4:
        raise CompressionError("Sharded data too short")
    at, out, known = 4, [], {}
    for _ in range(int.from_bytes(data[:4], "little")):
        if at + 9 > len(data):
            raise CompressionError("Sharded data has truncated metadata")
        kind, original, packed = data[at], int.from_bytes(data[at + 1 : at + 5], "little"), int.from_bytes(data[at + 5 : at + 9], "little")
        at += 9
        if kind not in NAMES:
            raise CompressionError(f"Unknown compression strategy: {kind}")
        if at + packed > len(data):
            raise CompressionError("Sharded data has truncated shard data")
        if kind not in known:
            known[kind] = codec(NAMES[kind])
        piece = known[kind].decompress(data[at : at + packed])
        if len(piece) != original:
            raise CompressionError("Decompressed size mismatch")
        out.append(piece)
        at += packed
    return b"".join(out)


def compress_sharded(data: Column, size: int = SHARD, strategy: str = "zstd") -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        act = codec(strategy).compress
        for batch in batches:
            yield pa.array([write_shards(x.as_py(), size, strategy, act) if x.is_valid else None for x in batch], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(data)


def decompress_sharded(data: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([read_shards(x.as_py()) if x.is_valid else None for x in batch], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(data)


def shard_error(data: Column) -> Column:
    """Why the sharded wire form can't be read; null if it can."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def of(x: bytes) -> str | None:
            try:
                read_shards(x)
            except CompressionError as e:
                return str(e)

        for batch in batches:
            yield pa.array([of(x.as_py()) if x.is_valid else None for x in batch], pa.string())

    return F.arrow_udf(run, T.StringType())(data)


# -- contexts --------------------------------------------------------------------------------------


def dictionary_length(size: Column, context: str | list[str], order: list[str], most: int = DICTIONARY) -> Column:
    """Bytes that a context's dictionary holds after each message: all so far, but the last `most` at most.

    A window by context; contexts are independent, and there is no cap on their number.
    """
    so_far = Window.partitionBy(context).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.least(F.lit(most).cast("long"), F.sum(size.cast("long")).over(so_far))


def compress_in_context(df: DataFrame, data: str, context: str, order: list[str], most: int = DICTIONARY, strategy: str = "zstd", clear: Column | None = None) -> DataFrame:
    """df with compressed and dictionary_size. The dictionary does not reach the codec, so messages stand alone.

    clear: whether a message's context is cleared before it; clear_all() tells it for all contexts at once.
    """
    if clear is not None:
        cleared = F.sum(F.coalesce(clear, F.lit(False)).cast("int")).over(Window.partitionBy(context).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_cleared", cleared)
    size = dictionary_length(F.octet_length(data), [context, "_cleared"] if clear is not None else context, order, most)
    return df.withColumn("compressed", compress(F.col(data), strategy)).withColumn("dictionary_size", size).drop("_cleared")


def clear_all(context: str, at: str, when: list) -> Column:
    """For compress_in_context(): whether a message is the first of its context since one of the times `when`, of column at, at which all contexts are cleared."""
    epoch = sum((F.col(at) >= F.lit(t)).cast("int") for t in when) if when else F.lit(0)
    return epoch > F.coalesce(F.max(epoch).over(Window.partitionBy(context).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def updated_dictionary(held: bytes, message: bytes, most: int = DICTIONARY) -> bytes:
    """The last `most` bytes of what a context has seen."""
    return (held + message)[-most:] if most else b""


def dictionaries(df: DataFrame, data: str, context: str, order: list[str], most: int = DICTIONARY) -> DataFrame:
    """Each context's dictionary after all its messages: only the last messages that fill it are gathered."""
    after = Window.partitionBy(context).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum(F.octet_length(data).cast("long")).over(after), F.lit(0))
    ranked = df.withColumn("_later", later).where(F.col("_later") < most)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.hex(data).alias("_digits"))))
    held = ranked.groupBy(context).agg(F.array_join(F.transform(parts, lambda p: p["_digits"]), "").alias("_all"))
    return held.select(context, F.unhex(F.right(F.col("_all"), F.lit(2 * most))).alias("dictionary"))


def contexts_in_stream(df: DataFrame, data: str, context: str, most: int = DICTIONARY, idle_ms: int | None = None, clear: str | None = None) -> DataFrame:
    """The streaming form of compress_in_context(): context, compressed and dictionary_size of each message.

    Each context's dictionary is state of its own. With idle_ms it is dropped after that long without
    messages, for which the stream runs batches even when no data come. clear: a boolean column; a message for which it
    holds finds its context cleared.
    """
    kind = df.schema[context].dataType
    out = T.StructType([T.StructField(context, kind), T.StructField("compressed", T.BinaryType()), T.StructField("dictionary_size", T.LongType())])
    held = T.StructType([T.StructField("dictionary", T.BinaryType())])

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        act = codec("zstd").compress
        seen = bytes(state.get[0]) if state.exists else b""
        for pdf in frames:
            packed, sizes = [], []
            for message, cleared in zip(pdf[data], pdf[clear] if clear else itertools.repeat(False)):
                if cleared:
                    seen = b""
                seen = updated_dictionary(seen, bytes(message), most)
                packed.append(act(bytes(message)))
                sizes.append(len(seen))
            yield pd.DataFrame({context: key[0], "compressed": packed, "dictionary_size": sizes})
        state.update((seen,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return df.groupBy(context).applyInPandasWithState(step, out, held, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
