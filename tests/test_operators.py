import json
import os

import pytest
from pyspark.sql import functions as F

from tagweave.functions.blake3 import digests
from tagweave.operators import compression, crypto, packets
from tagweave.plans import inference, schema


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(31744))
    got = [d.hex()[:16] for d in digests([b"", data[:1], data[:1024], data[:1025], data, b"abc"])]
    assert got == ["af1349b9f5f9a1a6", "2d3adedff11b61f1", "42214739f095a406", "d00278ae47eb27b3", "62b6960e1a44bcc1", "6437b3ac38465133"]


def test_packets(spark):
    df = spark.sql("SELECT 1L s, 1678886400L t, 10L h, 5L f, 0 k, unhex('0102030405') b")
    p = bytes(df.select(packets.build(*(F.col(c) for c in "sthfkb")).alias("p")).first().p)
    cases = [p, p[:-33] + b"\xff" + p[-32:], p[:-10], p[:12], p[:11] + b"\x63" + p[12:], None, b""]
    rows = packets.verified(spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(cases)], "i int, p binary"), "p").orderBy("i").collect()
    assert [r.error for r in rows] == [None, "Checksum verification failed", "Incomplete data for Checksum", "Incomplete data for Checksum", "Unknown DataBodyType value: 99", None, "Incomplete varint data"]
    assert (rows[0].schema_id, rows[0].timestamp, rows[0].shard_id, rows[0].flow_flags, bytes(rows[0].body)) == (1, 1678886400, 10, 5, b"\1\2\3\4\5")


def test_flags(spark):
    row = spark.sql("SELECT 252L f").select(packets.with_strategy(F.col("f"), "zstd").alias("z"), packets.strategy_of(F.lit(2)).alias("n")).first()
    assert row.z == 253 and row.n is None


def test_zstd_and_shards(spark):
    data = bytes(i % 256 for i in range(10_000))
    wire = compression.write_shards(data, 1000, "zstd")
    assert compression.read_shards(wire) == data and wire[:4] == bytes([10, 0, 0, 0])
    assert compression.write_shards(b"", 10, "zstd") == b"" and compression.read_shards(b"") == b""
    with pytest.raises(compression.CompressionError):
        compression.codec("zstd").decompress(b"\xff\xff\xff")
    df = spark.createDataFrame([(bytearray(b"\xff"),), (None,)], "b binary")
    assert [r.v for r in df.select(compression.decompress(F.col("b"), on_error="null").alias("v")).collect()] == [None, None]


def test_brotli_says_what_it_needs():
    try:
        import brotli  # noqa: F401
    except ImportError:
        with pytest.raises(compression.CompressionError, match="brotli"):
            compression.compress(None, "brotli")


def test_contexts_batch_equals_stream(spark, tmp_path):
    rows = [(c, t, bytearray(os.urandom(30 + t))) for c in (1, 2) for t in range(6)]
    df = spark.createDataFrame(rows, "c long, t long, data binary")
    batch = sorted((r.c, r.dictionary_size) for r in compression.compress_in_context(df, "data", "c", ["t"], 100).collect())
    df.orderBy("c", "t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = compression.contexts_in_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "data", "c", 100)
    q = stream.writeStream.format("memory").queryName("contexts").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.c, r.dictionary_size) for r in spark.sql("SELECT * FROM contexts").collect()) == batch


def test_dictionary_keeps_the_tail():
    assert compression.updated_dictionary(b"a" * 90, b"b" * 30, 100) == b"a" * 70 + b"b" * 30
    assert compression.updated_dictionary(b"", b"c" * 200, 100) == b"c" * 100


def test_rfc_vectors():
    key, nonce = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypto.chacha_seal(key, nonce, plain, bytes.fromhex("50515253c0c1c2c3c4c5c6c7"))
    assert sealed[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691" and sealed[:4].hex() == "d31a8d34"
    point = crypto.x25519(bytes.fromhex("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4"), bytes.fromhex("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c"))
    assert point.hex() == "c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552"


def test_wrong_keys_fail():
    secret = os.urandom(32)
    sealed = crypto.ecc_seal(crypto.public_key(secret), b"hi")
    assert crypto.ecc_open(secret, sealed) == b"hi"
    with pytest.raises(crypto.EncryptionError):
        crypto.ecc_open(os.urandom(32), sealed)
    with pytest.raises(crypto.EncryptionError, match="unsupported"):
        crypto.encrypt(F, "kyber")


def test_key_manager():
    now = [0.0]
    keys = crypto.KeyManager(lambda: now[0])
    a = keys.generate("aes", lifetime=10)
    assert keys.primary("aes") == a
    now[0] = 1
    b = keys.rotate("aes", keep=1)
    assert keys.primary("aes") == b and {k.id for k in keys.list("aes")} == {a.id, b.id}
    now[0] = 11
    with pytest.raises(crypto.EncryptionError, match="expired"):
        keys.get(a.id)
    keys.rotate("aes")
    assert len(keys.list("aes")) == 1


def test_parser():
    parse = schema.Parser({"money": schema.SchemaType("float64")}).parse
    s = parse(json.dumps({"id": "x", "name": "x", "version": "1.2", "properties": {"a": {"type": "integer", "format": "uint8", "tag": 3, "required": True, "minimum": 2, "default": 7}, "m": {"type": "map", "values": "money"}, "u": {"type": ["string", "null"]}}}))
    assert str(s.version) == "1.2.0" and s.type.fields[0].tag == 3 and s.type.fields[0].default == 7 and s.type.fields[0].constraints.minimum == 2
    assert s.type.fields[1].type.value.name == "float64" and s.type.fields[2].type.name == "union"
    for bad in ({"id": "x"}, {"id": "x", "name": "x"}, {"id": "x", "name": "x", "type": "array"}, {"id": "x", "name": "x", "type": "what"}):
        with pytest.raises(schema.SchemaError):
            parse(bad)


def test_mapping_limits():
    u8 = schema.SchemaType("uint8")
    assert schema.to_item(255, u8).value == 255 and schema.to_item(0.0, schema.SchemaType("float32")).value == 0.0
    for value, kind in ((256, "uint8"), (-1, "uint16"), (1.5, "int8"), (True, "int8"), ("x", "binary"), (1e39, "float32")):
        with pytest.raises(schema.SchemaError):
            schema.to_item(value, schema.SchemaType(kind))
    union = schema.SchemaType("union", members=(u8, schema.SchemaType("string")))
    assert schema.to_item("a", union).name == "string"
    kept = schema.to_item({"a": 1, "z": 3}, schema.SchemaType("object", fields=(schema.SchemaField("a", 1, u8),)), keep_unknown=True)
    assert [i.name for i in kept.items] == ["u8", "i8"]


def test_inference(spark):
    docs = ['{"a": 1, "b": [1, -2], "c": "aGVsbG8gd29ybGQ="}', '{"a": 300, "b": [], "c": "aGVsbG8gd29ybGQ=", "d": null}', '{"a": "x", "b": [3]}', None]
    s = inference.infer(spark.createDataFrame([(d,) for d in docs], "j string"), "j", "s", "s")
    kinds = {f.name: (f.type.name, f.required) for f in s.type.fields}
    assert kinds == {"a": ("union", True), "b": ("array", True), "c": ("binary", False), "d": ("null", False)}
    with pytest.raises(schema.SchemaError):
        inference.infer(spark.createDataFrame([], "j string"), "j", "s", "s")


def test_recursive_defaults(spark):
    inner = schema.SchemaType("object", fields=(schema.SchemaField("x", 1, schema.SchemaType("int32")), schema.SchemaField("y", 2, schema.SchemaType("string"), default="d")))
    kind = schema.SchemaType("object", fields=(schema.SchemaField("o", 1, inner), schema.SchemaField("l", 2, schema.SchemaType("array", items=inner))))
    df = spark.createDataFrame([((None, "k"), [(5, None)]), (None, None)], "o struct<x:int,y:string>, l array<struct<x:int,y:string>>")
    rows = df.select(*schema.with_defaults({c: F.col(c) for c in "ol"}, kind, "recursive")).collect()
    assert rows[0].o == (0, "k") and rows[0].l == [(5, "d")] and rows[1].o is None and rows[1].l == []


def test_flat_rows_are_read_as_walked_ones_are():
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    from tagweave.operators import codec

    kind = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.StringType()), T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("y", T.ByteType()), T.StructField("z", T.BinaryType(), metadata={"tag": 300})])
    rng = np.random.default_rng(3)
    item, names = codec.Item, ("i64", "string", "f64", "bool", "i8", "bytes")

    def row():
        values = (int(rng.integers(-9, 9)), "é" * int(rng.integers(0, 700)), float(rng.normal()), bool(rng.integers(2)), int(rng.integers(-128, 128)), bytes(rng.integers(0, 256, rng.integers(0, 20)).astype("u1")))
        items = [item(t, n if rng.random() > 0.1 else "null", v) for t, n, v in zip((1, 2, 3, 4, 5, 300), names, values, strict=True)]
        items = [i if i.name != "null" else item(i.tag, "null") for i in items]
        return codec.write_item(item(7, "object", items=[items[i] for i in (rng.permutation(6)[: rng.integers(0, 7)] if rng.random() < 0.2 else range(6))]))

    rows = [row() for _ in range(300)] + [None, codec.write_item(item(0, "object")), codec.write_item(item(1, "i64", 5)), codec.write_item(item(0, "object", items=[item(2, "string", "12345678"), item(1, "u8", 3)]))]
    arrow = to_arrow_type(kind)
    flat, done = codec.read_flat(pa.array(rows, pa.binary()).slice(0), kind, arrow)
    assert 100 < done.sum() < len(rows)
    for raw, got, ok in zip(rows, flat.to_pylist(), done, strict=True):
        if ok:
            assert got == (None if raw is None else codec.as_python(codec.read_item(raw)[0], kind))
    cut = [r[: rng.integers(0, len(r))] for r in rows[:100]]
    assert not codec.read_flat(pa.array(cut, pa.binary()), kind, arrow)[1].any()


def test_headers_are_read_as_walked_ones_are(spark):
    import numpy as np

    from tagweave.operators import codec

    rng = np.random.default_rng(4)
    raws = [bytes(rng.integers(0, 256, rng.integers(0, 60)).astype("u1") & (0xFF if i % 2 else 0x83)) for i in range(400)]
    got = packets.verified(spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, p binary"), "p").orderBy("i").collect()
    for raw, r in zip(raws, got, strict=True):
        try:
            fields, head, body, checksum = packets.read_packet(raw)
            assert r.error == (None if digests([head + body])[0] == checksum else "Checksum verification failed")
            assert (r.schema_id % 2**64, r.timestamp % 2**64, r.shard_id % 2**64, r.flow_flags, r.body_type) == fields
        except codec.CodecError as e:
            assert r.error == str(e).removeprefix("Codec Error: ") and r.schema_id is None


def test_overlong_header_is_checked_as_encoded_anew(spark):
    signed = b"\x01\x00\x00" + bytes(4) + b"\x00" + b"body"
    packet = b"\x81\x00\x00\x00" + bytes(4) + b"\x00" + b"body" + digests([signed])[0]
    row = packets.verified(spark.createDataFrame([(bytearray(packet),)], "p binary"), "p").first()
    assert row.error is None and row.schema_id == 1 and bytes(row.body) == b"body"


def test_unknown_strategy_is_an_error(spark):
    with pytest.raises(Exception, match="Unknown compression strategy bits in flow_flags: 2"):
        spark.range(1).select(packets.known_strategy_of(F.lit(6))).collect()
    with pytest.raises(Exception, match="Unknown body variant"):
        n = F.lit(0).cast("long")
        spark.range(1).select(packets.build_variant(n, n, n, n, F.lit("zip"), F.lit(b"x"))).collect()


def test_error_kinds():
    from tagweave.functions import errors

    assert len(errors.KINDS) == 10 and str(errors.of_io(OSError("gone"))) == "Codec Error: IO Error during codec operation: gone"
    assert errors.kind_of(str(schema.SchemaError("x"))) == "schema" and errors.kind_of("x") is None


def test_keys_of_rows(spark):
    df = spark.createDataFrame([(i, bytearray(os.urandom(32)), f"text {i}") for i in range(3)], "i int, k binary, t string")
    sealed = df.withColumn("s", crypto.encrypt(F.col("t").cast("binary"), "aes_gcm", F.col("k")))
    assert [r.o for r in sealed.select(crypto.decrypt(F.col("s"), "aes_gcm", F.col("k")).cast("string").alias("o")).collect()] == ["text 0", "text 1", "text 2"]


def test_inference_of_names_that_are_data(spark, monkeypatch):
    docs = spark.createDataFrame([(json.dumps({f"k{i}": 1}),) for i in range(40)], "j string")
    assert len(inference.infer(docs, "j", "s", "s").type.fields) == 40
    monkeypatch.setattr(inference, "MOST_PATHS", 10)
    with pytest.raises(schema.SchemaError, match="names in these objects are data"):
        inference.infer(docs, "j", "s", "s")


@pytest.mark.parametrize(
    ("value", "name", "within", "number"),
    [("65535.49D", "uint16", False, 65535), ("65535.0D", "uint16", True, 65535), ("32767.26D", "int16", False, 32767), ("-0.25D", "uint8", False, 0), ("-128.5D", "int8", False, -128), ("65535.49BD", "uint16", False, 65535), ("cast('255.000000001' as decimal(38,9))", "uint8", False, 255), ("256L", "uint8", False, None), ("-1", "uint8", False, None),
     ("9223372036854775808D", "int64", False, None), ("-9223372036854775808D", "int64", True, -(2**63)), ("9223372036854775808D", "uint64", True, 2**63), ("1e19D", "uint64", True, 10**19), ("18446744073709551616D", "uint64", False, None), ("cast('18446744073709551615' as decimal(20,0))", "uint64", True, 2**64 - 1), ("double('inf')", "uint8", False, None), ("double('nan')", "int32", False, None), ("cast(null as double)", "int8", None, None)],
)
def test_numeric_ranges(spark, value, name, within, number):
    row = spark.sql(f"SELECT {value} v FROM range(1)").select(schema.in_range(F.col("v"), name).alias("r"), schema.to_number(F.col("v"), name).alias("n")).first()
    assert row.r == within and (row.n if row.n is None else int(row.n)) == number
