import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions import scalars, text, varint
from tagweave.operators import codec
from tagweave.operators.codec import CodecError, Item, read_item, write_item


def values(item: Item):
    return [(x.tag, values(x)) for x in item.items] if item.name in ("array", "object") else item.value


@pytest.mark.parametrize(("value", "digits"), [(0, "00"), (1, "01"), (127, "7F"), (128, "8001"), (255, "FF01"), (300, "AC02"), (-1, "FFFFFFFFFFFFFFFFFF01")])
def test_varint_golden(spark, value, digits):
    df = spark.createDataFrame([(value,)], "v long").select(varint.encode(F.col("v")).alias("e"))
    row = df.select(F.hex("e").alias("h"), varint.decode(F.col("e")).alias("d")).first()
    assert row.h == digits
    assert (row.d.bits, row.d.read, row.d.error) == (value, len(digits) // 2, None)


def test_varint_errors(spark):
    rows = [(bytearray(b"\x80"),), (bytearray(b"\xff" * 9),), (bytearray(b"\xff" * 10 + b"\1"),), (bytearray(b""),)]
    got = [r.d.error for r in spark.createDataFrame(rows, "b binary").select(varint.decode(F.col("b")).alias("d")).collect()]
    assert got == ["Incomplete varint data", "Incomplete varint data", "Varint value too large", "Incomplete varint data"]


def test_u64_bits(spark):
    row = spark.sql("SELECT cast('18446744073709551615' as decimal(20,0)) v").select(F.hex(varint.encode(varint.bits_of(F.col("v")))).alias("h"), varint.unsigned(varint.bits_of(F.col("v"))).alias("u")).first()
    assert row.h == "FFFFFFFFFFFFFFFFFF01" and int(row.u) == 2**64 - 1


@pytest.mark.parametrize(
    ("name", "value", "digits"),
    [("bool", "true", "01"), ("u8", "255", "FF"), ("u16", "65535", "FFFF"), ("u32", "4294967295L", "FFFFFFFF"), ("u64", "1234567890L", "D202964900000000"), ("i8", "-128", "80"), ("i16", "-32768", "0080"), ("i32", "-2147483648", "00000080"), ("i64", "-1L", "FFFFFFFFFFFFFFFF"), ("f32", "float(3.14)", "C3F54840"), ("f64", "3.14D", "1F85EB51B81E0940"), ("string", "'你好'", "E4BDA0E5A5BD")],
)
def test_scalar_golden(spark, name, value, digits):
    row = spark.sql(f"SELECT {value} v").select("v", F.hex(scalars.encode(F.col("v"), name)).alias("h"), scalars.decode(scalars.encode(F.col("v"), name), name).alias("back")).first()
    assert row.h == digits and row.back == row.v


@pytest.mark.parametrize(
    ("name", "value", "digits"),
    [("u8", 255, "FF"), ("u8", 256, "0001"), ("u16", 2**16, "00000100"), ("u32", 2**32, "0000000001000000"), ("i8", -128, "80"), ("i8", -129, "7FFF"), ("i16", 32768, "00800000"), ("i16", -32769, "FF7FFFFF"), ("i32", -(2**31) - 1, "FFFFFF7FFFFFFFFF"), ("i64", -(2**63), "0000000000000080"), ("i16", None, None)],
)
def test_scalars_beyond_their_type(spark, name, value, digits):
    df = spark.createDataFrame([(value,)], "v bigint").select(scalars.encode_fitting(F.col("v"), name).alias("b"))
    row = df.select(F.hex("b").alias("h"), scalars.decode_fitting(F.col("b"), name).cast("bigint").alias("back")).first()
    assert (row.h, row.back) == (digits, value)


def test_wrong_width_is_null(spark):
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(scalars.decode(F.col("b"), "u32").alias("v")).first().v is None


def test_typeless(spark):
    assert spark.sql("SELECT 1L t, cast('hello' as binary) v").select(F.hex(codec.encode_typeless(F.col("t"), F.col("v"))).alias("h")).first().h == "010568656C6C6F"


def test_tree_golden():
    array = bytes.fromhex("0A0E0B0104040A00000002010101")
    assert values(read_item(array)[0]) == [(1, 10), (2, True)]
    assert values(read_item(array, "compat")[0]) == [(1, [(0, 10)]), (2, True)]
    obj = bytes.fromhex("140F0E010D046E616D65020E0401020105")
    assert values(read_item(obj)[0]) == [(1, "name"), (2, [(1, 5)])]
    assert read_item(array + b"\xff\xff")[1] == len(array)


@pytest.mark.parametrize(
    ("data", "what"),
    [("0A0E0B0104040A00", "Incomplete data for Value"), ("", "No root item decoded"), ("0110", "Unknown type"), ("01", "Incomplete data for Type"), ("010303000000", "must be a multiple of 2"), ("010202000000", "Invalid length"), ("010D01FF", "UTF-8"), ("0A0E0301040411111111", "overruns")],
)
def test_decode_errors(data, what):
    with pytest.raises(CodecError, match=what):
        read_item(bytes.fromhex(data))


def test_packed_numbers_are_arrays():
    item = read_item(bytes.fromhex("0104") + b"\x08" + bytes.fromhex("0A00000014000000"))[0]
    assert values(item) == [(0, 10), (0, 20)]


def test_depth_limit():
    def nested(n):
        item = Item(1, "array")
        for _ in range(n - 1):
            item = Item(1, "array", items=[item])
        return write_item(item)

    read_item(nested(32))
    with pytest.raises(CodecError, match="nesting depth"):
        read_item(nested(33))


@pytest.mark.parametrize("size", [0, 8, 1023, 1024, 1025, 2048, 2148, 5000])
def test_large_fields(spark, size):
    data = bytes(i % 256 for i in range(size))
    item = Item(1, "object", items=[Item(2, "bytes", data), Item(3, "string", "é" * size), Item(2, "bytes", b"x")])
    back = read_item(write_item(item))[0]
    assert [x.value for x in back.items] == [data, "é" * size, b"x"]
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    row = df.select(codec.encode_item(7, "bytes", F.col("b")).alias("e")).select("e", codec.decode_value(F.col("e"), T.BinaryType()).alias("v")).first()
    assert bytes(row.v) == data and bytes(row.e) == write_item(Item(7, "bytes", data))


leaf = st.one_of(
    st.builds(Item, st.integers(0, 2**64 - 1), st.just("i64"), st.integers(-(2**63), 2**63 - 1)),
    st.builds(Item, st.integers(0, 300), st.just("u64"), st.integers(0, 2**64 - 1)),
    st.builds(Item, st.integers(0, 300), st.just("f64"), st.floats(allow_nan=False)),
    st.builds(Item, st.integers(0, 300), st.just("string"), st.text(max_size=20)),
    st.builds(Item, st.integers(0, 300), st.just("bool"), st.booleans()),
    st.builds(Item, st.integers(0, 300), st.just("null")),
)
tree = st.recursive(leaf, lambda x: st.builds(lambda t, n, i: Item(t, n, items=i), st.integers(0, 300), st.sampled_from(["array", "object"]), st.lists(x, max_size=4)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(tree)
def test_trees_come_back(item):
    data = write_item(item)
    back, read = read_item(data)
    assert read == len(data) and back.tag == item.tag and values(back) == values(item)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_decode_or_fail(data):
    for mode in ("logical", "compat"):
        try:
            read_item(data, mode)
        except CodecError:
            pass


def test_nested_columns(spark):
    kind = T.StructType.fromDDL("a int, b struct<c: string, d: array<bigint>>, e map<string, double>, f boolean, g binary, h float")
    rows = [(1, ("x", [1, 2]), {"k": 2.5}, True, bytearray(b"\0\1"), 0.5), (None, None, None, None, None, None), (-5, (None, []), {}, False, bytearray(b""), -1.0)]
    df = spark.createDataFrame(rows, kind)
    back = df.select(codec.decode_value(codec.encode_rows(kind), kind).alias("r")).select("r.*").collect()
    assert back == df.collect()


def test_permissive_decode(spark):
    df = spark.createDataFrame([(bytearray(b"\xff"),), (None,)], "b binary")
    assert [r.v for r in df.select(codec.decode_value(F.col("b"), T.LongType(), on_error="null").alias("v")).collect()] == [None, None]
    assert df.select(codec.decode_nodes(F.col("b")).alias("d")).first().d.error.startswith("Codec Error")


@pytest.mark.parametrize(("name", "data"), [("u8", [1, 2, 3]), ("i32", [100, -200, 300]), ("f32", [1.0, 2.5, 4.125]), ("u64", [2**63, 5]), ("i16", [])])
def test_batches(spark, name, data):
    kind = scalars.NUMBERS[name].spark
    df = spark.createDataFrame([(data if name != "u64" else list(map(int, data)),)], f"v array<{'decimal(20,0)' if name == 'u64' else kind}>") if name != "u64" else spark.sql(f"SELECT array({','.join(f'cast({x} as decimal(20,0))' for x in data)}) v")
    assert list(map(float, df.select(codec.decode_batch(codec.encode_batch(F.col("v"), name), name).alias("b")).first().b)) == list(map(float, data))


@pytest.mark.parametrize(
    ("name", "data", "kind", "size"),
    [("u8", [1, 255], "u8", 2), ("u8", [1, 256], "u16", 4), ("u16", [0, 2**32 - 1], "u32", 8), ("u32", [2**32, 2**63 - 1], "u64", 16), ("i8", [-128, 127], "i8", 2), ("i8", [-129], "i16", 2), ("i16", [32768, -1], "i32", 8), ("i32", [-(2**31) - 1], "i64", 8), ("i64", [-(2**63), 2**63 - 1], "i64", 16), ("i16", [], "i16", 0), ("u32", None, "u32", None)],
)
def test_batches_beyond_their_type(spark, name, data, kind, size):
    df = spark.createDataFrame([(data,), ([7],)], "v array<bigint>").coalesce(1).select("v", codec.encode_batch_fitting(F.col("v"), name).alias("b"))
    first, second = df.select("v", "b", F.octet_length("b.data").alias("size"), codec.decode_batch_fitting(F.col("b"), name).cast("array<bigint>").alias("back")).collect()
    assert (scalars.NAMES[first.b.type], first.size, first.back) == (kind, size, data)
    assert (scalars.NAMES[second.b.type], second.back) == (name, [7])


def test_batches_of_no_type(spark):
    df = spark.sql("SELECT array(-1L) v")
    with pytest.raises(Exception, match="-1 is out of range for u8"):
        df.select(codec.encode_batch_fitting(F.col("v"), "u8")).collect()
    wide = spark.sql("SELECT array(cast('18446744073709551615' as decimal(20,0))) v")
    assert int(wide.select(codec.decode_batch_fitting(codec.encode_batch_fitting(F.col("v"), "u64"), "u64").alias("b")).first().b[0]) == 2**64 - 1


def test_blocks(spark):
    data = bytes.fromhex("010201") + b"\x06" + bytes.fromhex("000700") + b"\x02" + b"hi"
    block, read = codec.read_block(data)
    assert read == len(data) and block["nested"][0]["value"] == b"hi"
    with pytest.raises(CodecError):
        codec.read_block(bytes.fromhex("00010800"))


def test_bytes_functions(spark):
    rows = [(bytearray("Hello, 世界!".encode()),), (bytearray(b"\xff"),), (bytearray(b"\x10\x02"),), (bytearray(b"a\0b"),), (bytearray(b""),)]
    df = spark.createDataFrame(rows, "b binary").select(text.utf8_length(F.col("b")).alias("n"), text.contains_nul(F.col("b")).alias("z"), text.sniff(F.col("b")).alias("s"))
    assert [tuple(r) for r in df.collect()] == [(10, False, "Text"), (None, False, "Binary"), (2, False, "Binary"), (3, True, "Text"), (0, False, "Unknown")]
