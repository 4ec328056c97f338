"""A query for each operator of the library, over the shared tables, and SQL for the same rows.

Binary results are compared as hexadecimal digits.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions import errors, scalars, text, varint
from tagweave.functions.blake3 import blake3
from tagweave.operators import codec, compression, crypto, packets
from tagweave.plans import inference, schema
from tagweave.sources import packets as store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = bytes(range(32))


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- pieces of SQL -----------------------------------------------------------------------------------


def sql_varint(x: str) -> str:
    """Digits of a varint of an SQL number from 0 to 2^63 - 1."""
    part = lambda i: f"lpad(hex((({x})::BIGINT >> {7 * i} & 127) + CASE WHEN ({x})::BIGINT >> {7 * i + 7} <> 0 THEN 128 ELSE 0 END), 2, '0')"
    return "(" + " || ".join([part(0), *(f"CASE WHEN ({x})::BIGINT >> {7 * i} <> 0 THEN {part(i)} ELSE '' END" for i in range(1, 9))]) + ")"


def sql_le(x: str, width: int) -> str:
    """Digits of an SQL integer in `width` bytes, low first."""
    return "(" + " || ".join(f"substr(lpad(hex(({x})::BIGINT), 16, '0'), {15 - 2 * i}, 2)" for i in range(width)) + ")"


def sql_f64(x: str) -> str:
    return sql_le(f"({x})::DOUBLE::BIT::BIGINT", 8)


def sql_item(tag: str, code: int, digits: str) -> str:
    return f"({sql_varint(tag)} || '{code:02X}' || {sql_varint(f'length({digits}) // 2')} || {digits})"


# -- numbers and scalars -----------------------------------------------------------------------------

_WIDE = "o_orderkey * o_custkey * o_custkey"


@query(f"SELECT o_orderkey, {sql_varint(_WIDE)} AS encoded FROM orders")
def varint_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", varint.encode_hex(F.expr(_WIDE)).alias("encoded"))


@query(f"SELECT o_orderkey, ({_WIDE})::DECIMAL(20,0)::VARCHAR AS value, length({sql_varint(_WIDE)}) // 2 AS read FROM orders")
def varint_roundtrip(spark, sf_dir):
    back = varint.decode(varint.encode(F.expr(_WIDE)))
    return table(spark, sf_dir, "orders").select("o_orderkey", back.alias("v")).select("o_orderkey", varint.unsigned(F.col("v.bits")).cast("string").alias("value"), F.col("v.read").cast("long").alias("read"))


_LE = {"u8": ("l_linenumber", 1), "u16": ("l_partkey % 65536", 2), "u32": ("l_orderkey * 7", 4), "u64": ("l_orderkey * l_partkey", 8), "i8": ("l_linenumber - 4", 1), "i16": ("l_suppkey - 500", 2), "i32": ("l_partkey - 10000", 4), "i64": ("(l_orderkey - 3000) * 1000003", 8)}


@query("SELECT l_orderkey, l_linenumber, l_shipdate, " + ", ".join(f"{sql_le(x, w)} AS {n}" for n, (x, w) in _LE.items()) + f", {sql_f64('l_extendedprice')} AS f64 FROM lineitem")
def le_encode(spark, sf_dir):
    columns = [scalars.encode_hex(F.expr(x), n).alias(n) for n, (x, _) in _LE.items()]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *columns, scalars.encode_hex(F.col("l_extendedprice"), "f64").alias("f64"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, " + ", ".join(f"({x})::BIGINT AS {n}" for n, (x, _) in _LE.items()) + ", l_extendedprice AS f64, l_discount::FLOAT::DOUBLE AS f32 FROM lineitem")
def le_decode(spark, sf_dir):
    """Scalars written and read back; integers beyond their type go in a wider one."""
    written = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount", *(scalars.encode_fitting(F.expr(x), n).alias(n) for n, (x, _) in _LE.items()))
    columns = [scalars.decode_fitting(F.col(n), n).cast("long").alias(n) for n in _LE]
    reals = [scalars.decode(scalars.encode(F.col(c), n), n).cast("double").alias(n) for n, c in (("f64", "l_extendedprice"), ("f32", "l_discount"))]
    return written.select("l_orderkey", "l_linenumber", "l_shipdate", *columns, *reals)


@query("SELECT c_custkey, c_acctbal > 0 AS flag, c_name AS string, c_mktsegment AS bytes FROM customer")
def scalar_decode_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        scalars.decode(scalars.encode(F.col("c_acctbal") > 0, "bool"), "bool").alias("flag"),
        scalars.decode(scalars.encode(F.col("c_name"), "string"), "string").alias("string"),
        scalars.decode(scalars.encode(F.col("c_mktsegment").cast("binary"), "bytes"), "bytes").cast("string").alias("bytes"),
    )


# -- items -------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {sql_item('c_custkey', 13, 'hex(c_name)')} AS item, {sql_varint('c_custkey')} || {sql_varint('strlen(c_name)')} || hex(c_name) AS typeless FROM customer")
def item_encode_flat(spark, sf_dir):
    tag = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(codec.encode_item(tag, "string", F.col("c_name"))).alias("item"), F.hex(codec.encode_typeless(tag, F.col("c_name").cast("binary"))).alias("typeless"))


_OWNER = " || ".join([sql_item("1", 9, sql_le("c_custkey", 8)), sql_item("2", 13, "hex(c_name)"), sql_item("3", 8, sql_le("c_nationkey", 4))])


def _owners(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")


@query(f"SELECT c_custkey, {sql_item('5', 15, 'fields')} AS item FROM (SELECT c_custkey, {_OWNER} AS fields FROM customer)")
def object_encode(spark, sf_dir):
    df = _owners(spark, sf_dir)
    return df.select("c_custkey", F.hex(codec.encode_rows(df.schema, 5)).alias("item"))


_ARRAY = " || ".join(sql_item(str(i), 9, sql_le(f"o_orderkey * {i + 1}", 8)) for i in range(3))


@query(f"SELECT o_orderkey, {sql_item('10', 14, f'({_ARRAY})')} AS item FROM orders")
def array_encode(spark, sf_dir):
    value = F.array(*(F.col("o_orderkey") * (i + 1) for i in range(3)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(codec.encode_value(value, T.ArrayType(T.LongType()), 10)).alias("item"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority FROM orders")
def object_decode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return df.select(codec.decode_value(codec.encode_rows(df.schema), df.schema).alias("r")).select("r.*")


@query(
    f"SELECT c_custkey, 0 AS node_id, NULL::INT AS parent_id, 0 AS depth, 5::VARCHAR AS tag, 15 AS type, NULL AS value FROM customer UNION ALL "
    f"SELECT c_custkey, 1, 0, 1, '1', 9, {sql_le('c_custkey', 8)} FROM customer UNION ALL SELECT c_custkey, 2, 0, 1, '2', 13, hex(c_name) FROM customer UNION ALL SELECT c_custkey, 3, 0, 1, '3', 8, {sql_le('c_nationkey', 4)} FROM customer"
)
def decode_node_table(spark, sf_dir):
    df = _owners(spark, sf_dir)
    nodes = df.select("c_custkey", codec.decode_nodes(codec.encode_rows(df.schema, 5)).alias("d")).select("c_custkey", F.inline("d.nodes"))
    return nodes.select("c_custkey", "node_id", "parent_id", "depth", F.col("tag").cast("string").alias("tag"), F.col("type").cast("int").alias("type"), F.hex("value").alias("value"))


@query(f"SELECT p_partkey, 14 AS type, 1 AS elements, '0' AS tag, {sql_le('p_size', 4)} AS value FROM part")
def compat_scalar_as_array(spark, sf_dir):
    item = codec.encode_item(7, "i32", F.col("p_size"))
    d = table(spark, sf_dir, "part").select("p_partkey", codec.decode_nodes(item, mode="compat").alias("d"))
    first = F.col("d.nodes")[1]
    return d.select("p_partkey", F.col("d.nodes")[0]["type"].cast("int").alias("type"), (F.size("d.nodes") - 1).alias("elements"), first["tag"].cast("string").alias("tag"), F.hex(first["value"]).alias("value"))


@query("SELECT o_orderkey, o_totalprice AS value FROM orders")
def field_by_tag(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    d = df.select("o_orderkey", codec.decode_nodes(codec.encode_rows(df.schema)).alias("d"))
    found = F.filter("d.nodes", lambda n: (n["depth"] == 1) & (n["tag"] == 3))[0]
    return d.select("o_orderkey", found["value"].alias("v")).select("o_orderkey", scalars.decode(F.col("v"), "f64").alias("value"))


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS place, unnest(embedding)::DOUBLE AS value FROM embeddings")
def batch_decode_embeddings(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    back = codec.decode_batch(codec.encode_batch(F.col("embedding"), "f32"), "f32")
    return df.select("vec_id", F.posexplode(back).alias("place", "v")).select("vec_id", "place", F.col("v").cast("double").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, unnest([l_orderkey, l_partkey, l_suppkey])::BIGINT AS value FROM lineitem")
def batch_decode_integers(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    back = codec.decode_batch(codec.encode_batch(F.array("l_orderkey", "l_partkey", "l_suppkey"), "u32"), "u32")
    return df.select("l_orderkey", "l_linenumber", "l_shipdate", F.explode(back).alias("value"))


#: Two values of each type of packed number, from columns of orders.
_PACKED = {
    "u8": ("o_orderkey % 256", "255"), "u16": ("o_custkey % 65536", "65535"), "u32": ("o_orderkey * 100003", "4294967295"), "u64": ("o_orderkey * 100000000003", "9223372036854775807"),
    "i8": ("o_orderkey % 256 - 128", "-1"), "i16": ("o_custkey % 65536 - 32768", "-1"), "i32": ("o_custkey * -100003", "2147483647"), "i64": ("o_orderkey * -100000000003", "-1"),
}


@query("SELECT o_orderkey, " + ", ".join(f"({x})::BIGINT AS {n}_first, {y}::BIGINT AS {n}_second" for n, (x, y) in _PACKED.items()) + ", o_totalprice::FLOAT::DOUBLE AS f32_first, -0.5::DOUBLE AS f32_second, o_totalprice AS f64_first, -o_totalprice AS f64_second FROM orders")
def batch_decode_all(spark, sf_dir):
    """Packed batches of every type of number, encoded and read back; integers beyond their type go in a wider one."""
    integers = {n: F.array(*(F.expr(f"cast({x} as bigint)") for x in of)) for n, of in _PACKED.items()}
    reals = {"f32": F.array(F.col("o_totalprice").cast("float"), F.lit(-0.5).cast("float")), "f64": F.array(F.col("o_totalprice"), -F.col("o_totalprice"))}
    packed = table(spark, sf_dir, "orders").select("o_orderkey", *(codec.encode_batch_fitting(v, n).alias(n) for n, v in integers.items()), *(codec.encode_batch(v, n).alias(n) for n, v in reals.items()))
    read = packed.select("o_orderkey", *(codec.decode_batch_fitting(F.col(n), n).alias(n) for n in integers), *(codec.decode_batch(F.col(n), n).alias(n) for n in reals))
    return read.select("o_orderkey", *(F.col(n)[i].cast("double" if n[0] == "f" else "long").alias(f"{n}_{('first', 'second')[i]}") for n in [*integers, *reals] for i in (0, 1)))


@query("SELECT * FROM (VALUES (1, NULL), (32, NULL), (33, 'Codec Error: Maximum nesting depth (32) exceeded')) t(depth, error)")
def nested_depth_guard(spark, sf_dir):
    def nested(n: int) -> bytes:
        item = codec.Item(1, "array", items=[])
        for _ in range(n - 1):
            item = codec.Item(1, "array", items=[item])
        return codec.write_item(item)

    df = spark.createDataFrame([(n, bytearray(nested(n))) for n in (1, 32, 33)], "depth int, data binary")
    return df.select("depth", codec.decode_nodes(F.col("data")).alias("d")).select("depth", "d.error")


_LARGE_BYTES = "CASE WHEN n > 1024 THEN 11 + (n // 1024) * 1028 + CASE WHEN n % 1024 > 0 THEN 2 + CASE WHEN n % 1024 > 127 THEN 2 ELSE 1 END + n % 1024 ELSE 0 END ELSE 2 + CASE WHEN n > 127 THEN 2 ELSE 1 END + n END"


@query(f"SELECT doc_id, ({_LARGE_BYTES})::BIGINT AS bytes FROM (SELECT doc_id, strlen(text) AS n FROM documents UNION ALL SELECT -1 - doc_id, 1020 + doc_id % 10 FROM documents)")
def large_field_shards(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    df = df.select("doc_id", "text").union(df.select(-1 - F.col("doc_id"), F.repeat(F.lit("A"), (1020 + F.col("doc_id") % 10).cast("int"))))
    return df.select("doc_id", F.octet_length(codec.encode_item(1, "string", F.col("text"))).cast("long").alias("bytes"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def large_field_reassemble(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", F.sha2(codec.decode_value(codec.encode_item(1, "string", F.col("text")), T.StringType()).cast("binary"), 256).alias("digest"))


_BLOCK = f"('00' || '07' || '00' || {sql_varint('strlen(c_name)')} || hex(c_name))"


@query(f"SELECT c_custkey, {_BLOCK} AS flat, '0102' || '01' || {sql_varint(f'length({_BLOCK})')} || {_BLOCK} || {_BLOCK} AS nested FROM customer")
def block_encode(spark, sf_dir):
    flat = codec.encode_block(F.lit(7), F.lit(0), F.col("c_name").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(flat).alias("flat"), F.hex(codec.encode_block(F.lit(258), F.lit(codec.NESTED), F.concat(flat, flat))).alias("nested"))


@query("SELECT c_custkey, depth, tag, flags, CASE WHEN depth = 1 THEN c_name END AS value FROM customer, (VALUES (0, 258, 1), (1, 7, 0), (1, 7, 0)) t(depth, tag, flags)")
def block_decode(spark, sf_dir):
    flat = codec.encode_block(F.lit(7), F.lit(0), F.col("c_name").cast("binary"))
    blocks = codec.decode_blocks(codec.encode_block(F.lit(258), F.lit(codec.NESTED), F.concat(flat, flat)))
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.inline(blocks))
    return df.select("c_custkey", "depth", "tag", F.col("flags").cast("int").alias("flags"), F.when(F.col("depth") == 1, F.col("value").cast("string")).alias("value"))


# -- functions on bytes ------------------------------------------------------------------------------


@query("SELECT doc_id, length(t) AS chars, contains(t, chr(0)) AS has_nul FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(0) || 'x' ELSE text END AS t FROM documents)")
def utf8_and_nul(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    data = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("0078")))).otherwise(F.col("text").cast("binary"))
    return df.select("doc_id", text.utf8_length(data).alias("chars"), text.contains_nul(data).alias("has_nul"))


_HEAD = "substr(hex(encode(t)), 1, 2048)"
_COUNTS = f"length({_HEAD}) // 2 AS total, length(regexp_replace({_HEAD}, '(3[0-9])|..', '\\1', 'g')) // 2 AS digits, length(regexp_replace({_HEAD}, '([2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)|..', '\\1', 'g')) // 2 AS shown"
_KIND = "CASE WHEN total = 0 THEN 'Unknown' WHEN digits > shown - digits AND digits > total - shown THEN 'Numeric' WHEN shown - digits > total - shown THEN 'Text' ELSE 'Binary' END"
_SAMPLES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN repeat(doc_id::VARCHAR, 3) || '-' WHEN 2 THEN repeat(chr(1) || chr(2), 5) || 'ab' ELSE '' END AS t FROM documents"


def _samples(spark, sf_dir):
    t = F.expr("CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN repeat(cast(doc_id as string), 3) || '-' WHEN 2 THEN repeat(chr(1) || chr(2), 5) || 'ab' ELSE '' END")
    return table(spark, sf_dir, "documents").select("doc_id", t.cast("binary").alias("data"))


@query(f"SELECT doc_id, {_KIND} AS kind FROM (SELECT doc_id, {_COUNTS} FROM ({_SAMPLES}))")
def sniff_data_type(spark, sf_dir):
    return _samples(spark, sf_dir).select("doc_id", text.sniff(F.col("data")).alias("kind"))


@query(f"SELECT doc_id, CASE kind WHEN 'Numeric' THEN 'zstd' WHEN 'Text' THEN 'brotli' WHEN 'Binary' THEN CASE WHEN doc_id % 30 < 10 THEN 'none' WHEN doc_id % 200 > 100 THEN 'zstd' ELSE 'brotli' END ELSE 'zstd' END AS strategy FROM (SELECT doc_id, {_KIND} AS kind FROM (SELECT doc_id, {_COUNTS} FROM ({_SAMPLES})))")
def pick_strategy(spark, sf_dir):
    return _samples(spark, sf_dir).select("doc_id", text.strategy_for(text.sniff(F.col("data")), F.col("doc_id") % 30, F.col("doc_id") % 200).alias("strategy"))


# -- packets -----------------------------------------------------------------------------------------

_HEADER = f"{sql_varint('user_id')} || {sql_varint('epoch_us(ts)')} || {sql_varint('event_id % 16')} || {sql_le('event_id % 1000 * 4 + 1', 4)} || '01'"


def _header(e: DataFrame) -> list:
    return [F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 16, F.col("event_id") % 1000 * 4 + 1, F.lit(packets.COMPRESSED)]


@query(f"SELECT event_id, {_HEADER} AS header FROM events")
def packet_header_encode(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.hex(packets.encode_header(*_header(df))).alias("header"))


@query(f"SELECT event_id, user_id AS schema_id, epoch_us(ts) AS timestamp, event_id % 16 AS shard_id, event_id % 1000 * 4 + 1 AS flow_flags, 1 AS body_type, length({_HEADER}) // 2 AS read, 'zstd' AS strategy, event_id % 1000 * 4 + 3 AS brotli_flags FROM events")
def packet_header_decode(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    d = df.select("event_id", packets.decode_header(packets.encode_header(*_header(df))).alias("h")).select("event_id", "h.*")
    return d.select("event_id", "schema_id", "timestamp", "shard_id", "flow_flags", "body_type", F.col("read").cast("long").alias("read"), packets.strategy_of(F.col("flow_flags")).alias("strategy"), packets.with_strategy(F.col("flow_flags"), "brotli").alias("brotli_flags"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'Checksum verification failed' WHEN event_id % 10 = 1 THEN 'Incomplete data for flow_flags' WHEN event_id % 10 = 2 THEN 'Unknown DataBodyType value: 99' WHEN event_id % 10 = 3 THEN 'Incomplete data for Checksum' END AS error, CASE WHEN event_id % 10 > 3 THEN props END AS body FROM events")
def packet_parse_status(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    fields = _header(df)
    head, body = packets.encode_header(*fields), F.col("props").cast("binary")
    df = df.withColumn("good", packets.build(*fields, body)).withColumn("at", F.octet_length(head))
    size = F.octet_length("good")
    flipped = F.concat(F.substring(F.col("good"), F.lit(1), size - 33), F.unhex(F.lit("00")), F.substring(F.col("good"), size - 31, F.lit(32)))
    kind = F.concat(F.substring(F.col("good"), F.lit(1), F.col("at") - 1), F.unhex(F.lit("63")), F.substring(F.col("good"), F.col("at") + 1, size))
    n = F.col("event_id") % 10
    packet = F.when(n == 0, flipped).when(n == 1, F.substring(F.col("good"), F.lit(1), F.col("at") - 3)).when(n == 2, kind).when(n == 3, F.substring(F.col("good"), F.lit(1), F.col("at") + 20)).otherwise(F.col("good"))
    return packets.verified(df.select("event_id", packet.alias("packet")), "packet").select("event_id", "error", F.col("body").cast("string").alias("body"))


@query(
    "SELECT event_id, event_id % 4 AS low, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'zstd' WHEN 3 THEN 'brotli' END AS strategy, CASE WHEN event_id % 4 = 2 THEN 'Codec Error: Unknown compression strategy bits in flow_flags: 2' END AS error,"
    " event_id // 4 * 4 AS as_none, event_id // 4 * 4 + 1 AS as_zstd, event_id // 4 * 4 + 3 AS as_brotli FROM events"
)
def packet_strategy(spark, sf_dir):
    """The strategy in all values of the flags' low bits, and the flags with each strategy put in."""
    flags = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (flags % 4).alias("low"), packets.strategy_of(flags).alias("strategy"), packets.strategy_error(flags).alias("error"), *(packets.with_strategy(flags, n).alias(f"as_{n}") for n in packets.STRATEGIES))


@query("SELECT event_id, event_id % 3 AS body_type, props AS body, event_id * 4 AS flow_flags, NULL AS error FROM events")
def packet_variants(spark, sf_dir):
    """Packets whose body type follows from the body's variant, parsed again."""
    df = table(spark, sf_dir, "events")
    variant = F.element_at(F.array(*map(F.lit, packets.VARIANTS)), (F.col("event_id") % 3 + 1).cast("int"))
    packet = packets.build_variant(F.lit(1).cast("long"), F.col("event_id"), F.lit(0).cast("long"), F.col("event_id") * 4, variant, F.col("props").cast("binary"))
    return packets.verified(df.select("event_id", packet.alias("packet")), "packet").select("event_id", F.col("body_type").cast("long").alias("body_type"), F.col("body").cast("string").alias("body"), "flow_flags", "error")


#: The first half of published digests of the bytes 0, 1, ..., 250, 0, ..., by how many. Fixed values.
_BLAKE3 = {0: "af1349b9f5f9a1a6", 1: "2d3adedff11b61f1", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 31744: "62b6960e1a44bcc1"}


@query("SELECT n_nationkey, size, digest FROM nation, (VALUES " + ", ".join(f"({n}, '{d}')" for n, d in _BLAKE3.items()) + ") t(size, digest)")
def blake3_vectors(spark, sf_dir):
    """Published digests, of inputs of up to 31 chunks among each other."""
    sizes = F.explode(F.array(*map(F.lit, _BLAKE3)))
    digits = F.array_join(F.transform(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.lpad(F.hex(i % 251), 2, "0")), "")
    df = table(spark, sf_dir, "nation").select("n_nationkey", sizes.alias("size"))
    return df.select("n_nationkey", "size", F.lower(F.substring(F.hex(blake3(F.unhex(digits))), 1, 16)).alias("digest"))


@query()
def blake3_digest(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(blake3(F.col("c_name").cast("binary")))).alias("digest"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 8 = 3")
def packet_store(spark, sf_dir):
    """Writes packets as a table, reads them back with a filter on a header field, and decodes."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 8).alias("part"))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tagweave-")
    path = f"{folder.rstrip('/')}/tagweave-packets-{uuid.uuid4().hex}"
    store.write(store.frame(df, 1, F.lit(0), F.col("part")), path)
    return store.unframe(store.read(spark, path).where("shard_id = 3"), df.schema).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def flagship_returnflag(spark, sf_dir):
    """Lines as object items in checked packets, read back and summed up."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    packed = store.frame(df, 1, F.lit(1_678_886_400), F.pmod(F.col("l_orderkey"), F.lit(16)))
    back = store.unframe(packed, df.schema)
    return back.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.count("*").alias("n"))


# -- compression -------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def zstd_roundtrip(spark, sf_dir):
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(compression.decompress(compression.compress(data, "zstd"), "zstd"), 256).alias("digest"))


@query("SELECT doc_id, (i - 1)::INT AS shard_index, least(1000, strlen(text) - 1000 * (i - 1))::INT AS original_size, 1 AS strategy FROM (SELECT doc_id, text, unnest(range(1, (strlen(text) + 999) // 1000 + 1)) AS i FROM documents)")
def shard_metadata(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return compression.to_shards(df, "data", 1000).select("doc_id", "shard_index", "original_size", F.col("strategy").cast("int").alias("strategy"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, text AS copy FROM documents")
def no_compression(spark, sf_dir):
    packed = compression.compress(F.col("text").cast("binary"), "none")
    df = table(spark, sf_dir, "documents").select("doc_id", packed.alias("packed"))
    return df.select("doc_id", F.octet_length("packed").cast("long").alias("bytes"), compression.decompress(F.col("packed"), "none").cast("string").alias("copy"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 <> 1 THEN sha256(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END) END AS digest FROM documents")
def sharded_rows_roundtrip(spark, sf_dir):
    """Values through rows of shards, some of them made empty and some null."""
    text = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 11 != 1, F.col("text"))
    df = table(spark, sf_dir, "documents").select("doc_id", text.cast("binary").alias("data"))
    return compression.from_shards(compression.to_shards(df, "data", 1000, keep_empty=True), ["doc_id"]).select("doc_id", F.sha2("data", 256).alias("digest"))


@query("SELECT page_id, sha256(html) AS digest, (strlen(html) + 999) // 1000 AS shards FROM pages")
def sharded_wire_roundtrip(spark, sf_dir):
    wire = compression.compress_sharded(F.col("html").cast("binary"), 1000)
    df = table(spark, sf_dir, "pages").select("page_id", wire.alias("wire"))
    count = scalars.decode(F.substring(F.col("wire"), F.lit(1), F.lit(4)), "u32")
    return df.select("page_id", F.sha2(compression.decompress_sharded(F.col("wire")), 256).alias("digest"), count.alias("shards"))


@query("SELECT * FROM (VALUES (1, NULL), (2, 'Compression Error: Sharded data too short'), (3, 'Compression Error: Sharded data has truncated metadata'), (4, 'Compression Error: Unknown compression strategy: 9'), (5, 'Compression Error: Sharded data has truncated shard data')) t(id, error)")
def sharded_wire_errors(spark, sf_dir):
    bad = [b"", b"\1\2\3", bytes([10, 0, 0, 0, 1, 2, 3]), bytes([1, 0, 0, 0, 9, 1, 0, 0, 0, 1, 0, 0, 0, 65]), bytes([1, 0, 0, 0, 0, 9, 0, 0, 0, 9, 0, 0, 0, 65])]
    df = spark.createDataFrame([(i + 1, bytearray(b)) for i, b in enumerate(bad)], "id int, data binary")
    return df.select("id", compression.shard_error(F.col("data")).alias("error"))


@query("SELECT conv_id, turn, least(1000, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS dictionary_size FROM conversations")
def incremental_dictionary_size(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("data", F.col("text").cast("binary"))
    return compression.compress_in_context(df, "data", "conv_id", ["turn"], 1000).select("conv_id", "turn", "dictionary_size")


@query("SELECT conv_id, turn, least(1000, sum(strlen(text)) OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn))::BIGINT AS dictionary_size FROM conversations")
def incremental_clear(spark, sf_dir):
    """Dictionaries of contexts that are cleared before every third turn."""
    df = table(spark, sf_dir, "conversations").withColumn("data", F.col("text").cast("binary"))
    return compression.compress_in_context(df, "data", "conv_id", ["turn"], 1000, clear=F.col("turn") % 3 == 0).select("conv_id", "turn", "dictionary_size")


@query("SELECT conv_id, turn, least(1000, sum(strlen(text)) OVER (PARTITION BY conv_id, turn >= 2, turn >= 5 ORDER BY turn))::BIGINT AS dictionary_size FROM conversations")
def incremental_clear_all(spark, sf_dir):
    """All contexts are cleared at turns 2 and 5."""
    df = table(spark, sf_dir, "conversations").withColumn("data", F.col("text").cast("binary"))
    return compression.compress_in_context(df, "data", "conv_id", ["turn"], 1000, clear=compression.clear_all("conv_id", "turn", [2, 5])).select("conv_id", "turn", "dictionary_size")


@query("SELECT conv_id, right(string_agg(hex(text), '' ORDER BY turn), 2000) AS dictionary FROM conversations GROUP BY conv_id")
def incremental_dictionary(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("data", F.col("text").cast("binary"))
    return compression.dictionaries(df, "data", "conv_id", ["turn"], 1000).select("conv_id", F.hex("dictionary").alias("dictionary"))


# -- schemas -----------------------------------------------------------------------------------------

_NUMERIC = {"orders": "o_orderkey", "customer": "c_acctbal", "lineitem": "l_linenumber", "part": "p_size - 25", "supplier": "s_suppkey * 1000000000"}


def _sql_type(x: str) -> str:
    cases = " ".join(f"WHEN {'min(v) < 0 AND min(v) >= ' + str(schema.RANGES[n][0]) if n[0] == 'i' else 'min(v) >= 0'} AND max(v) <= {schema.RANGES[n][1]} THEN '{n}'" for n in ("int8", "int16", "int32", "uint8", "uint16", "uint32"))
    return f"CASE WHEN bool_or(v::DOUBLE <> floor(v::DOUBLE)) THEN 'float32' {cases} WHEN min(v) < 0 THEN 'int64' ELSE 'uint64' END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, {_sql_type(x)} AS type FROM (SELECT {x} AS v FROM {t})" for t, x in _NUMERIC.items()))
def infer_numeric_type(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.expr(x).alias("v")).agg(F.lit(t).alias("source"), inference.number_type_name(F.col("v")).alias("type")) for t, x in _NUMERIC.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query("SELECT CASE WHEN bool_and(strlen(c_name) > 8 AND regexp_full_match(c_name, '[A-Za-z0-9+/=]*')) THEN 'binary' ELSE 'string' END AS plain, CASE WHEN bool_and(strlen(sha256(c_name)) > 8 AND regexp_full_match(sha256(c_name), '[A-Za-z0-9+/=]*')) THEN 'binary' ELSE 'string' END AS digest FROM customer")
def infer_string_kind(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.agg(inference.string_kind(F.col("c_name")).alias("plain"), inference.string_kind(F.sha2(F.col("c_name").cast("binary"), 256)).alias("digest"))


_JSON = """'{"id": ' || event_id || CASE WHEN event_id % 20 > 0 THEN ', "kind": "' || event_type || ' x"' ELSE '' END || CASE WHEN event_id % 5 > 0 THEN ', "n": ' || (event_id % 300) ELSE '' END || ', "mix": ' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE 'true' END || ', "list": [' || (event_id % 7 - 3) || ', 5]' || '}'"""


def _json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_JSON.replace("|| event_id ||", "|| cast(event_id as string) ||")).alias("data"))


@query(
    "SELECT * FROM (SELECT 'id' AS name, CASE WHEN max(event_id) < 256 THEN 'uint8' WHEN max(event_id) < 65536 THEN 'uint16' ELSE 'uint32' END AS type, true AS required FROM events UNION ALL "
    "SELECT 'kind', 'string', count(*) FILTER (event_id % 20 > 0) >= 0.9 * count(*) FROM events UNION ALL SELECT 'n', CASE WHEN max(event_id % 300) < 256 THEN 'uint8' ELSE 'uint16' END, count(*) FILTER (event_id % 5 > 0) >= 0.9 * count(*) FROM events UNION ALL "
    "SELECT 'mix', 'union(boolean,uint8)', true UNION ALL SELECT 'list', 'array(int8)', true)"
)
def infer_schema(spark, sf_dir):
    """Field names, types (with a union and an array) and whether required, inferred from JSON."""
    found = inference.infer(_json(spark, sf_dir), "data", "events", "events")

    def shown(t: schema.SchemaType) -> str:
        return f"union({','.join(shown(m) for m in t.members)})" if t.name == "union" else f"array({shown(t.items)})" if t.name == "array" else t.name

    return spark.createDataFrame([(f.name, shown(f.type), f.required) for f in found.type.fields], "name string, type string, required boolean")


_PROPS = schema.SchemaType("object", fields=(schema.SchemaField("k", 4, schema.SchemaType("uint8"), required=True),))


@query(f"SELECT event_id, {sql_item('0', 15, sql_item('4', 2, sql_le('CAST(json_extract(props, chr(36) || chr(46) || chr(107)) AS BIGINT)', 1)))} AS item FROM events")
def json_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.hex(schema.json_to_items(F.col("props"), _PROPS)).alias("item"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extra' ELSE '' END AS unknown FROM events")
def unknown_fields(spark, sf_dir):
    data = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"\}$", ', "extra": 1}')).otherwise(F.col("props"))
    names = F.json_object_keys(data)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(schema.unknown_names(names, _PROPS), ",").alias("unknown"))


_CUSTOMER = schema.SchemaType(
    "object",
    fields=(
        schema.SchemaField("c_name", 1, schema.SchemaType("string"), required=True),
        schema.SchemaField("c_acctbal", 2, schema.SchemaType("float64")),
        schema.SchemaField("c_mktsegment", 3, schema.SchemaType("string"), default="GENERAL"),
    ),
)


def _holed(spark, sf_dir):
    hole = lambda c, n: F.when(F.col("c_custkey") % n != 0, F.col(c)).alias(c)
    return table(spark, sf_dir, "customer").select("c_custkey", hole("c_name", 3), hole("c_acctbal", 4), hole("c_mktsegment", 5))


def _defaults_sql(name: str, balance: str, segment: str) -> str:
    pick = lambda c, n, d: f"CASE WHEN c_custkey % {n} <> 0 THEN {c} ELSE {d} END AS {c}"
    return f"SELECT c_custkey, {pick('c_name', 3, name)}, {pick('c_acctbal', 4, balance)}, {pick('c_mktsegment', 5, segment)} FROM customer"


def _defaults(strategy: str, sql: str):
    def run(spark, sf_dir):
        df = _holed(spark, sf_dir)
        custom = {"c_name": "nobody"} if strategy == "custom" else None
        return df.select("c_custkey", *schema.with_defaults({f.name: F.col(f.name) for f in _CUSTOMER.fields}, _CUSTOMER, strategy, custom))

    run.__name__ = f"apply_defaults_{strategy}"
    query(sql)(run)


for _strategy, _of in {"none": ("NULL", "NULL", "NULL"), "required": ("''", "NULL", "'GENERAL'"), "all": ("''", "0.0", "'GENERAL'"), "recursive": ("''", "0.0", "'GENERAL'"), "custom": ("'nobody'", "NULL", "NULL")}.items():
    _defaults(_strategy, _defaults_sql(*_of))

_PART = schema.SchemaType("object", fields=(schema.SchemaField("x", 1, schema.SchemaType("int64")), schema.SchemaField("y", 2, schema.SchemaType("string"), default="d")))
_WHOLE = schema.SchemaType("object", fields=(schema.SchemaField("one", 1, _PART), schema.SchemaField("sure", 2, _PART, required=True), schema.SchemaField("many", 3, schema.SchemaType("array", items=_PART))))


@query(
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END END AS one_x, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'd' END END AS one_y,"
    " CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS sure_x, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'd' END AS sure_y,"
    " CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 2 END AS many, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 2 <> 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END END AS first_x, CASE WHEN o_orderkey % 7 <> 0 THEN 'd' END AS second_y FROM orders"
)
def apply_defaults_nested(spark, sf_dir):
    """Recursive defaults: missing fields of objects within, and of objects in arrays."""
    k = F.col("o_orderkey")
    x, y = F.when(k % 3 == 0, F.col("o_custkey")), F.when(k % 5 == 0, F.col("o_orderstatus"))
    one = F.when(k % 2 == 0, F.struct(x.alias("x"), y.alias("y")))
    bare = F.struct(F.lit(None).cast("long").alias("x"), F.lit(None).cast("string").alias("y"))
    many = F.when(k % 7 != 0, F.array(one, bare))
    df = table(spark, sf_dir, "orders").select(k.alias("k"), one.alias("one"), one.alias("sure"), many.alias("many"))
    df = df.select("k", *schema.with_defaults({c: F.col(c) for c in ("one", "sure", "many")}, _WHOLE, "recursive"))
    return df.select("k", "one.x", "one.y", "sure", "many").select("k", F.col("x").alias("one_x"), F.col("y").alias("one_y"), F.col("sure.x").alias("sure_x"), F.col("sure.y").alias("sure_y"), F.size("many").alias("many"), F.get("many", 0)["x"].alias("first_x"), F.get("many", 1)["y"].alias("second_y"))


_MONEY = schema.Parser({"money": schema.SchemaType("float32"), "key": schema.SchemaType("int64")})
_PRICED = {"id": "priced", "name": "priced", "properties": {"o_orderkey": {"type": "key", "tag": 1}, "o_totalprice": {"type": "money", "tag": 2}, "o_orderstatus": {"type": "string", "tag": 3}}}


_PRICED_SQL = " || ".join([sql_item("1", 9, sql_le("o_orderkey", 8)), sql_item("2", 10, sql_le("(o_totalprice::FLOAT)::BIT::INTEGER", 4)), sql_item("3", 13, "hex(o_orderstatus)")])


@query(f"SELECT o_orderkey, {sql_item('0', 15, 'fields')} AS item FROM (SELECT o_orderkey, {_PRICED_SQL} AS fields FROM orders)")
def schema_mapping(spark, sf_dir):
    """Rows encoded by a schema whose document names types of one's own."""
    kind = _MONEY.parse(_PRICED).type.spark()
    return table(spark, sf_dir, "orders").select("o_orderkey", F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields)).alias("r")).select("o_orderkey", F.hex(codec.encode_value(F.col("r"), kind)).alias("item"))


_PREDICATES = {
    "null": (0, 0, 0, 0), "boolean": (0, 0, 0, 0), **dict.fromkeys(("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64"), (1, 1, 0, 0)), **dict.fromkeys(("float32", "float64"), (1, 0, 1, 0)),
    **dict.fromkeys(("binary", "string"), (0, 0, 0, 0)), **dict.fromkeys(("array", "object", "map", "union"), (0, 0, 0, 1)),
}


@query("SELECT name, numeric = 1 AS is_numeric, whole = 1 AS is_integer, float = 1 AS is_float, complex = 1 AS is_complex FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in _PREDICATES.items()) + ") t(name, numeric, whole, float, complex)")
def type_predicates(spark, sf_dir):
    kinds = [schema.SchemaType(n) for n in _PREDICATES]
    return spark.createDataFrame([(k.name, k.is_numeric, k.is_integer, k.is_float, k.is_complex) for k in kinds], "name string, is_numeric boolean, is_integer boolean, is_float boolean, is_complex boolean")


_EVENTS = ("click", "view", "purchase", "error", "login", "logout", "signup", "scroll", "search")


@query("SELECT event_type, CASE event_type " + " ".join(f"WHEN '{n}' THEN '{schema.tag_from_name(n)}'" for n in _EVENTS) + " END AS tag FROM (SELECT DISTINCT event_type FROM events)")
def tag_of_name(spark, sf_dir):
    """The JVM's hash of a name, which the tags that the driver makes must equal."""
    return table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", varint.unsigned(F.xxhash64("event_type")).cast("string").alias("tag"))


_RULES = schema.SchemaType(
    "object",
    fields=(
        schema.SchemaField("c_name", 1, schema.SchemaType("string"), required=True, constraints=schema.Constraints(min_length=5, max_length=18, pattern="[02468]$")),
        schema.SchemaField("c_acctbal", 2, schema.SchemaType("float64"), constraints=schema.Constraints(minimum=0, maximum=9000)),
        schema.SchemaField("c_custkey", 3, schema.SchemaType("uint8")),
    ),
)


@query(
    "SELECT c_custkey, (CASE WHEN name IS NULL THEN 1 ELSE 0 END + CASE WHEN strlen(name) < 5 THEN 1 ELSE 0 END + CASE WHEN strlen(name) > 18 THEN 1 ELSE 0 END + CASE WHEN NOT regexp_matches(name, '[02468]$') THEN 1 ELSE 0 END"
    " + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END + CASE WHEN c_custkey > 255 THEN 1 ELSE 0 END)::INT AS violations FROM (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer)"
)
def validate_constraints(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    return df.select("c_custkey", F.size(schema.violations({c: F.col(c) for c in ("c_name", "c_acctbal", "c_custkey")}, _RULES)).alias("violations"))


_U8, _I16 = schema.SchemaType("uint8"), schema.SchemaType("int16")
_DEEP = schema.SchemaType(
    "object",
    fields=(
        schema.SchemaField("list", 1, schema.SchemaType("array", items=_U8), constraints=schema.Constraints(max_length=3)),
        schema.SchemaField("map", 2, schema.SchemaType("map", key=schema.SchemaType("string"), value=_U8)),
        schema.SchemaField("any", 3, schema.SchemaType("union", members=(_I16, schema.SchemaType("string"), schema.SchemaType("array", items=_U8)))),
        schema.SchemaField("objects", 4, schema.SchemaType("array", items=schema.SchemaType("object", fields=(schema.SchemaField("n", 1, _U8, required=True),)))),
    ),
)


@query(
    "SELECT event_id, concat_ws(';', CASE WHEN event_id % 400 > 255 THEN 'list[1]: out of range for uint8' END, CASE WHEN event_id % 5 = 0 THEN 'list: longer than 3' END, CASE WHEN event_id % 300 > 255 THEN 'map[b]: out of range for uint8' END,"
    " CASE WHEN event_id % 6 IN (1, 3, 5) THEN 'any: does not match any type in union' END, CASE WHEN event_id % 7 = 0 THEN 'objects[1].n: required field is missing' WHEN event_id % 7 = 1 THEN 'objects[1].n: out of range for uint8' END) AS found FROM events"
)
def validate_nested(spark, sf_dir):
    """What is wrong in arrays, maps, unions and objects in arrays."""
    k = F.col("event_id")
    values = F.array(F.lit(1).cast("smallint"), (k % 400).cast("smallint"), F.lit(2).cast("smallint"))
    columns = {
        "list": F.when(k % 5 == 0, F.concat(values, F.array(F.lit(3).cast("smallint")))).otherwise(values),
        "map": F.create_map(F.lit("a"), F.lit(7).cast("smallint"), F.lit("b"), (k % 300).cast("smallint")),
        "any": F.parse_json(F.element_at(F.array(*map(F.lit, ("-300", "40000", '"text"', "true", "[1, 255]", "[1, 256]"))), (k % 6 + 1).cast("int"))),
        "objects": F.array(F.struct(F.lit(1).cast("smallint").alias("n")), F.struct(F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, 999).otherwise(9).cast("smallint").alias("n"))),
    }
    df = table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in columns.items()))
    return df.select("event_id", F.array_join(schema.violations({n: F.col(n) for n in columns}, _DEEP), ";").alias("found"))


_TREE = schema.SchemaType(
    "object",
    fields=(
        schema.SchemaField("id", 1, schema.SchemaType("uint32"), required=True),
        schema.SchemaField("who", 2, schema.SchemaType("object", fields=(schema.SchemaField("type", 1, schema.SchemaType("string")), schema.SchemaField("raw", 2, schema.SchemaType("binary"))))),
        schema.SchemaField("list", 3, schema.SchemaType("array", items=_I16)),
        schema.SchemaField("map", 4, schema.SchemaType("map", key=schema.SchemaType("string"), value=_U8)),
        schema.SchemaField("any", 5, schema.SchemaType("union", members=(_U8, schema.SchemaType("string")))),
        schema.SchemaField("left", 6, schema.SchemaType("int8"), default=-5),
        schema.SchemaField("flag", 7, schema.SchemaType("boolean")),
    ),
)
_TREE_JSON = """'{"id": ' || event_id || ', "who": {"type": "' || event_type || '", "raw": "AQL/"}, "list": [-1, ' || (event_id % 1000) || '], "map": {"a": 1, "b": ' || (event_id % 256) || '}, "any": ' || CASE WHEN event_id % 2 = 0 THEN '9' ELSE '"nine"' END || ', "flag": ' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || ', "extra": ' || (event_id % 200) || '}'"""


def _sql_known_item(tag_hex: str, code: int, digits: str) -> str:
    return f"('{tag_hex}' || '{code:02X}' || {sql_varint(f'length({digits}) // 2')} || {digits})"


def _tree_sql() -> str:
    """Level by level, so that each item is a column when its length is asked for."""
    key = lambda c: sql_item("0", 13, f"hex('{c}')")
    leaves = {
        "id": sql_item("1", 4, sql_le("event_id", 4)),
        "who": sql_item("1", 13, "hex(event_type)") + " || " + sql_item("2", 12, "'0102FF'"),
        "list": sql_item("0", 7, "'FFFF'") + " || " + sql_item("1", 7, sql_le("event_id % 1000", 2)),
        "a": key("a") + " || " + sql_item("1", 2, "'01'"),
        "b": key("b") + " || " + sql_item("1", 2, sql_le("event_id % 256", 1)),
        "either": f"""CASE WHEN event_id % 2 = 0 THEN {sql_item('5', 2, "'09'")} ELSE {sql_item('5', 13, "hex('nine')")} END""",
        "left_": sql_item("6", 6, "'FB'"),
        "flag": f"""CASE WHEN event_id % 3 = 0 THEN {sql_item('7', 1, "'01'")} ELSE {sql_item('7', 1, "'00'")} END""",
    }
    tag = varint.literal_hex(schema.tag_from_name("extra"))
    leaves["extra"] = f"CASE WHEN event_id % 200 < 128 THEN {_sql_known_item(tag, 6, sql_le('event_id % 200', 1))} ELSE {_sql_known_item(tag, 7, sql_le('event_id % 200', 2))} END"
    first = "SELECT event_id, " + ", ".join(f"{x} AS {n}" for n, x in leaves.items()) + " FROM events"
    second = f"SELECT *, {sql_item('0', 15, 'a')} || {sql_item('1', 15, 'b')} AS pairs FROM ({first})"
    third = f"SELECT event_id, id || {sql_item('2', 15, 'who')} || {sql_item('3', 14, 'list')} || {sql_item('4', 15, 'pairs')} || either || left_ || flag || extra AS whole FROM ({second})"
    return f"SELECT event_id, {sql_item('0', 15, 'whole')} AS item FROM ({third})"


@query(_tree_sql())
def json_map_nested(spark, sf_dir):
    """JSON with objects, arrays, maps, unions and binaries within, absent fields by default, and fields that the schema doesn't know kept."""
    text = F.expr(_TREE_JSON.replace("|| event_id ||", "|| cast(event_id as string) ||"))
    return table(spark, sf_dir, "events").select("event_id", F.hex(schema.json_to_items(text, _TREE, keep_unknown=True, defaults="all")).alias("item"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice BETWEEN 0 AND 65535 AS u16, l_extendedprice - 30000 BETWEEN -32768 AND 32767 AS i16, abs(l_extendedprice * 1e34) <= 3.4028234663852886e38 AS f32, CASE WHEN trunc(l_extendedprice) <= 65535 THEN trunc(l_extendedprice)::INT END AS as_u16 FROM lineitem")
def numeric_range(spark, sf_dir):
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", schema.in_range(x, "uint16").alias("u16"), schema.in_range(x - 30000, "int16").alias("i16"), schema.in_range(x * 1e34, "float32").alias("f32"), schema.to_number(x, "uint16").alias("as_u16"))


@query("SELECT * FROM (VALUES ('orders', '1.9.0', '2.1.0', true, false)) t(id, latest, highest, same_major, other_major)")
def registry_latest(spark, sf_dir):
    """Schemas from their text form, registered out of order."""
    registry = schema.Registry()
    for version in ("1.0.0", "2.1.0", "1.9.0"):
        registry.register(schema.Parser().parse(json.dumps({"id": "orders", "name": "orders", "version": version, "properties": {"key": {"type": "integer", "format": "int64", "required": True}}})))
    last, top = registry.latest("orders"), registry.latest("orders", by_version=True)
    first = registry.get("orders", schema.Version(1, 0, 0))
    return spark.createDataFrame([("orders", str(last.version), str(top.version), last.version.compatible(first.version), last.version.compatible(top.version))], "id string, latest string, highest string, same_major boolean, other_major boolean")


# -- encryption --------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name AS aes, c_name AS chacha, strlen(c_name) + 28 AS sealed_bytes, true AS wrong_key_fails FROM customer")
def seal_and_open(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("data", F.col("c_name").cast("binary"))
    df = df.withColumn("a", crypto.encrypt(F.col("data"), "aes_gcm", KEY)).withColumn("c", crypto.encrypt(F.col("data"), "chacha20_poly1305", KEY))
    wrong = crypto.decrypt(F.col("a"), "aes_gcm", bytes(32)).isNull() & crypto.decrypt(F.col("c"), "chacha20_poly1305", bytes(32)).isNull()
    return df.select("c_custkey", crypto.decrypt(F.col("a"), "aes_gcm", KEY).cast("string").alias("aes"), crypto.decrypt(F.col("c"), "chacha20_poly1305", KEY).cast("string").alias("chacha"), F.octet_length("c").cast("long").alias("sealed_bytes"), wrong.alias("wrong_key_fails"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def seal_to_public_key(spark, sf_dir):
    sealed = crypto.encrypt(F.col("s_name").cast("binary"), "ecc", crypto.public_key(KEY))
    return table(spark, sf_dir, "supplier").select("s_suppkey", crypto.decrypt(sealed, "ecc", KEY).cast("string").alias("name"))


class _Vault:
    """Keys kept outside of the manager."""

    def __init__(self):
        self.keys: dict[str, crypto.Key] = {}

    def get(self, key_id: str) -> crypto.Key | None:
        return self.keys.get(key_id)

    def put(self, key: crypto.Key) -> None:
        self.keys[key.id] = key


@query("SELECT c_custkey, c_name AS opened, true AS other_fails FROM customer")
def external_keys(spark, sf_dir):
    """Values sealed under a key that one manager made and another gets from the same provider."""
    vault = _Vault()
    made, other = crypto.KeyManager(provider=vault).generate("aes"), crypto.KeyManager(provider=vault).generate("aes")
    found = crypto.KeyManager(provider=vault).get(made.id).material
    df = table(spark, sf_dir, "customer").select("c_custkey", crypto.encrypt(F.col("c_name").cast("binary"), "aes_gcm", made.material).alias("sealed"))
    return df.select("c_custkey", crypto.decrypt(F.col("sealed"), "aes_gcm", found).cast("string").alias("opened"), crypto.decrypt(F.col("sealed"), "aes_gcm", other.material).isNull().alias("other_fails"))


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def field_level_crypto(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    policy = crypto.FieldPolicy("none", {"c_name": "aes_gcm", "c_mktsegment": "chacha20_poly1305"}, {"*": KEY})
    return crypto.decrypt_fields(crypto.encrypt_fields(df, policy), policy, df.schema)


@query("SELECT key_id, kind FROM (SELECT c_custkey AS key_id, c_mktsegment AS kind, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 2")
def key_rotation(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("created"))
    return crypto.newest_keys(keys, 2).select("key_id", "kind")


# -- errors ------------------------------------------------------------------------------------------

_PREFIXES = {k: e.prefix for k, e in errors.KINDS.items()}


@query("SELECT e.event_id, kind, prefix || ': ' || event_type AS message FROM events e, (VALUES " + ", ".join(f"({i}, '{k}', '{p}')" for i, (k, p) in enumerate({"placeholder": "Placeholder Error", "codec": "Codec Error", "protocol": "Protocol Error", "compression": "Compression Error", "encryption": "Encryption Error", "schema": "Schema Error", "predicate": "Predicate Error", "index": "Index Error", "wasm": "Wasm Error", "internal": "Internal Error"}.items())) + ") t(i, kind, prefix) WHERE event_id % 10 = i")
def error_kinds(spark, sf_dir):
    """Messages of all kinds of errors, and the kind told from each."""
    kinds = F.array(*map(F.lit, _PREFIXES.values()))
    message = F.concat(F.get(kinds, (F.col("event_id") % 10).cast("int")), F.lit(": "), F.col("event_type"))
    prefix = F.regexp_extract("message", "^([A-Z][a-z]+ Error): ", 1)
    known = F.create_map(*(F.lit(x) for k, p in _PREFIXES.items() for x in (p, k)))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message")).select("event_id", known[prefix].alias("kind"), "message")
