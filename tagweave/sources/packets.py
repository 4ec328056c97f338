"""Tables of packets: Parquet with the header fields as columns beside the packet, so filters on them reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators import codec, packets


def frame(df: DataFrame, schema_id: int, timestamp, shard_id, flags: int = 0) -> DataFrame:
    """A packet of each row: its columns as one object item. Keeps schema_id, timestamp and shard_id as columns."""
    body = codec.encode_rows(df.schema)
    head = df.select(F.lit(schema_id).cast("long").alias("schema_id"), timestamp.cast("long").alias("timestamp"), shard_id.cast("long").alias("shard_id"), body.alias("_body"))
    built = packets.build(F.col("schema_id"), F.col("timestamp"), F.col("shard_id"), F.lit(flags).cast("long"), F.lit(packets.RAW), F.col("_body"))
    return head.withColumn("packet", built).drop("_body")


def unframe(packed: DataFrame, schema: T.StructType, on_error: str = "fail") -> DataFrame:
    """The rows of packets, checked and decoded. on_error: "fail", or "drop" for packets that can't be read."""
    checked = packets.verified(packed.select("packet"), "packet")
    if on_error == "fail":
        body = F.when(F.col("error").isNull(), F.col("body")).otherwise(F.raise_error(F.col("error")).cast("binary"))
    else:
        checked, body = checked.where(F.col("error").isNull()), F.col("body")
    return checked.select(codec.decode_value(body, schema, on_error="fail" if on_error == "fail" else "null").alias("_row")).select("_row.*")


def write(packed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    packed.write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """schema_id, timestamp, shard_id, packet. Filters on the first three are pushed to Parquet."""
    return spark.read.parquet(path)
