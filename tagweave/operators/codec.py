"""Tagged items: `varint tag, type byte, varint length, value`.

Encoding is a Column expression built from a column's data type, so it stays within generated code.
Decoding gives either a table of nodes or, for a known schema, typed columns. Objects of scalar fields in the
schema's order are read field by field, numpy over all rows of a batch; other rows are walked with an explicit stack.

mode "logical" (default) gives back what was encoded: one-element batches are scalars and sharded large
fields are joined. mode "compat" keeps the wire's own view: every multi-byte number is an array of
elements with tag 0, and a sharded field is its header alone. strict rejects children that overrun
their parent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions import scalars, varint, vector
from tagweave.functions.binding import bind
from tagweave.functions.errors import CodecError
from tagweave.functions.scalars import CODES, NAMES, NUMBERS

#: Bytes and strings longer than this are cut to shards of this size.
LARGE = 1024
#: Arrays and objects within each other, at most.
MOST_NESTED = 32
DTYPES = {k: np.dtype(f"<{'u' if v.kind == 'u' else v.kind}{v.width}") for k, v in NUMBERS.items()}
_U64 = (1 << 64) - 1


# -- encoding --------------------------------------------------------------------------------------


def item_hex(tag: Column | int, code: int, value_hex: Column) -> Column:
    if isinstance(tag, int):
        return bind(value_hex, lambda v: F.concat(F.lit(f"{varint.literal_hex(tag)}{code:02X}"), varint.encode_hex((F.length(v) / 2).cast("long")), v))
    both = F.struct(varint.encode_hex(tag).alias("tag"), value_hex.alias("value"))
    return bind(both, lambda b: F.concat(b["tag"], F.lit(f"{code:02X}"), varint.encode_hex((F.length(b["value"]) / 2).cast("long")), b["value"]))


def encode_item(tag: Column | int, name: str, value: Column, sharded: bool = True) -> Column:
    """BINARY item of a scalar. Bytes and strings longer than LARGE are a header item that holds the length, and shard items."""
    digits = scalars.encode_hex(value, name)
    return F.unhex(_large(tag, CODES[name], digits) if sharded and name in ("bytes", "string") else item_hex(tag, CODES[name], digits))


def _large(tag: Column | int, code: int, digits: Column) -> Column:
    def cut(v: Column) -> Column:
        size = (F.length(v) / 2).cast("long")
        header = item_hex(tag, code, scalars.encode_hex(size, "u64"))
        shards = F.transform(F.regexp_extract_all(v, F.lit(f".{{1,{2 * LARGE}}}"), F.lit(0)), lambda s: item_hex(tag, code, s))
        return F.when(size > LARGE, F.concat(header, F.array_join(shards, ""))).otherwise(item_hex(tag, code, v))

    return bind(digits, cut)


def encode_typeless(tag: Column, value: Column) -> Column:
    """`varint tag, varint length, value`, without a type."""
    return F.unhex(F.concat(varint.encode_hex(tag), varint.encode_hex(F.octet_length(value).cast("long")), F.hex(value)))


def wire_name(kind: T.DataType) -> str:
    """The wire type that a Spark type is encoded as. Times are microseconds since 1970."""
    for of, name in (
        (T.NullType, "null"), (T.BooleanType, "bool"), (T.ByteType, "i8"), (T.ShortType, "i16"), (T.IntegerType, "i32"), (T.LongType, "i64"), (T.FloatType, "f32"), (T.DoubleType, "f64"),
        (T.BinaryType, "bytes"), (T.StringType, "string"), (T.TimestampType, "i64"), (T.TimestampNTZType, "i64"), (T.DateType, "i32"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"),
    ):
        if isinstance(kind, of):
            return name
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 20:
        return "u64"
    raise CodecError(f"no wire type for {kind.simpleString()}")


def tag_of(f: T.StructField, place: int) -> int:
    """A field's tag: from its metadata, else its place from 1."""
    return int(f.metadata.get("tag", place + 1))


def _value_hex(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.concat(F.lit(""), *(_field_hex(tag_of(f, i), value[f.name], f.dataType) for i, f in enumerate(kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x, i: _field_hex(i.cast("long"), x, kind.elementType)), "")
    if isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_field_hex(0, e["key"], kind.keyType), _field_hex(1, e["value"], kind.valueType))
        return F.array_join(F.transform(F.map_entries(value), lambda e, i: item_hex(i.cast("long"), CODES["object"], entry(e))), "")
    if isinstance(kind, T.TimestampType):
        return scalars.encode_hex(F.unix_micros(value), "i64")
    if isinstance(kind, T.TimestampNTZType):
        return scalars.encode_hex(F.unix_micros(value.cast("timestamp")), "i64")
    if isinstance(kind, T.DateType):
        return scalars.encode_hex(F.unix_date(value), "i32")
    return scalars.encode_hex(value, wire_name(kind))


def _field_hex(tag: Column | int, value: Column, kind: T.DataType) -> Column:
    """A null value is an item of type null."""
    code, digits = CODES[wire_name(kind)], _value_hex(value, kind)
    whole = _large(tag, code, digits) if isinstance(kind, T.StringType | T.BinaryType) else item_hex(tag, code, digits)
    return whole if isinstance(kind, T.NullType) else F.when(value.isNull(), item_hex(tag, 0, F.lit(""))).otherwise(whole)


def encode_value(value: Column, kind: T.DataType, tag: Column | int = 0) -> Column:
    """BINARY item of a value of any Spark type: structs, arrays and maps nest."""
    return F.unhex(_field_hex(tag, value, kind))


def encode_rows(schema: T.StructType, tag: int = 0) -> Column:
    """One object item of a row's columns, for a DataFrame of that schema."""
    return encode_value(F.struct(*(F.col(f.name) for f in schema.fields)), schema, tag)


# -- decoding --------------------------------------------------------------------------------------


@dataclass
class Item:
    tag: int
    name: str
    value: Any = None
    items: list[Item] = field(default_factory=list)
    start: int = 0
    end: int = 0


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise CodecError("Incomplete varint data")
        byte = data[at + i]
        value |= (byte & 127) << (7 * i)
        if byte < 128:
            return value & _U64, at + i + 1
    raise CodecError("Varint value too large")


def read_scalar(name: str, data: bytes) -> Any:
    if name == "bytes":
        return data
    if name == "string":
        try:
            return data.decode()
        except UnicodeDecodeError:
            raise CodecError("Invalid UTF-8 in String") from None
    if name == "null":
        if data:
            raise CodecError("Invalid length for Null")
        return None
    if len(data) != 1:
        raise CodecError(f"Invalid length for {name}")
    return data[0] != 0 if name == "bool" else int.from_bytes(data, "little", signed=name == "i8")


def read_batch(name: str, data: bytes) -> list:
    """All elements of a packed run of numbers."""
    if name not in DTYPES:
        raise CodecError("Unsupported type for batch processing")
    if len(data) % NUMBERS[name].width:
        raise CodecError(f"Invalid data length for batch decoding: must be a multiple of {NUMBERS[name].width}")
    return np.frombuffer(data, DTYPES[name]).tolist()


def read_item(data: bytes, mode: str = "logical", strict: bool = True, at: int = 0) -> tuple[Item, int]:
    """The first item and where it ends; what follows is left alone."""
    root: Item | None = None
    stack: list[Item] = []
    offset = at
    while root is None:
        while stack and offset >= stack[-1].end:
            done = stack.pop()
            offset = done.end
            if mode == "logical":
                done.items = joined(done.items)
            if stack:
                stack[-1].items.append(done)
            else:
                root = done
                break
        if root is not None:
            break
        if offset >= len(data) and not stack:
            raise CodecError("No root item decoded")
        start = offset
        tag, offset = read_varint(data, offset)
        if offset >= len(data):
            raise CodecError("Incomplete data for Type")
        code = data[offset]
        if code not in NAMES:
            raise CodecError(f"Unknown type: {code}")
        name = NAMES[code]
        length, offset = read_varint(data, offset + 1)
        end = offset + length
        if end > len(data):
            raise CodecError("Incomplete data for Value")
        if strict and stack and end > stack[-1].end:
            raise CodecError("Item overruns its parent")
        if code >= CODES["array"]:
            if len(stack) >= MOST_NESTED:
                raise CodecError(f"Maximum nesting depth ({MOST_NESTED}) exceeded")
            stack.append(Item(tag, name, start=start, end=end))
            continue
        raw = data[offset:end]
        offset = end
        if code in range(CODES["u16"], CODES["u64"] + 1) or code in range(CODES["i16"], CODES["f64"] + 1):
            values = read_batch(name, raw)
            if mode == "logical" and len(values) == 1:
                item = Item(tag, name, values[0], start=start, end=end)
            else:
                item = Item(tag, "array", items=[Item(0, name, v) for v in values], start=start, end=end)
        elif mode == "logical" and name == "string" and length == 8 and (big := int.from_bytes(raw, "little")) > LARGE and big < 1 << 40:
            item = Item(tag, name, raw, start=start, end=end)  # perhaps the header of a sharded string
        else:
            # shards may part a character, so their text is judged when they are joined
            item = Item(tag, name, raw if mode == "logical" and name == "string" else read_scalar(name, raw), start=start, end=end)
        if stack:
            stack[-1].items.append(item)
        else:
            root = item
    if mode == "logical" and root.name in ("bytes", "string") and len(root.value) == 8:
        parts = [root]
        following = offset
        wanted = int.from_bytes(root.value, "little")
        while LARGE < wanted and sum(len(p.value) for p in parts[1:]) < wanted and following < len(data):
            try:
                tag, p = read_varint(data, following)
                code = data[p] if p < len(data) else -1
                length, q = read_varint(data, p + 1)
            except CodecError:
                break
            if tag != root.tag or code != CODES[root.name] or q + length > len(data):
                break
            parts.append(Item(tag, root.name, data[q : q + length], start=following, end=q + length))
            following = q + length
        whole = joined(parts)
        if len(whole) == 1:
            return whole[0], following
    return (joined([root])[0] if mode == "logical" else root), offset


def joined(items: list[Item]) -> list[Item]:
    """Items with sharded large fields put together: a header of eight bytes that hold a length over LARGE, then same items of LARGE bytes, the last at most, of that length in all."""
    out, i = [], 0
    while i < len(items):
        head = items[i]
        i += 1
        if head.name not in ("bytes", "string") or not isinstance(head.value, bytes):
            out.append(head)
            continue
        if len(head.value) == 8 and (wanted := int.from_bytes(head.value, "little")) > LARGE:
            j, got = i, 0
            while j < len(items) and got < wanted and items[j].tag == head.tag and items[j].name == head.name and isinstance(items[j].value, bytes) and len(items[j].value) == min(LARGE, wanted - got):
                got += len(items[j].value)
                j += 1
            if got == wanted:
                head = Item(head.tag, head.name, b"".join(x.value for x in items[i:j]), start=head.start, end=items[j - 1].end)
                i = j
        if head.name == "string":
            head.value = read_scalar("string", head.value)
        out.append(head)
    return out


def _value_bytes(item: Item) -> bytes | None:
    if item.value is None:
        return None
    if item.name in DTYPES:
        return np.array(item.value, DTYPES[item.name]).tobytes()
    return item.value.encode() if item.name == "string" else item.value if item.name == "bytes" else bytes([item.value])


NODE = "struct<node_id:int,parent_id:int,depth:int,ordinal:int,tag:decimal(20,0),type:tinyint,value:binary,start:int,end:int>"
_NODE_TYPE = pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("ordinal", pa.int32()), ("tag", pa.decimal128(20, 0)), ("type", pa.int8()), ("value", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])


def nodes_of(root: Item) -> list[dict]:
    """A row for each item, parents first. Values are little-endian bytes."""
    out, stack = [], [(root, None, 0, 0)]
    while stack:
        item, parent, depth, ordinal = stack.pop()
        number = len(out)
        out.append({"node_id": number, "parent_id": parent, "depth": depth, "ordinal": ordinal, "tag": Decimal(item.tag), "type": CODES[item.name], "value": _value_bytes(item), "start": item.start, "end": item.end})
        stack.extend((child, number, depth + 1, i) for i, child in reversed(list(enumerate(item.items))))
    return out


def decode_nodes(data: Column, mode: str = "logical", strict: bool = True) -> Column:
    """struct<nodes array, read int, error string> of the first item in BINARY; inline() its nodes for a table."""
    kind = pa.struct([("nodes", pa.list_(_NODE_TYPE)), ("read", pa.int32()), ("error", pa.string())])

    @F.arrow_udf(f"struct<nodes:array<{NODE}>,read:int,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for raw in batch.to_pylist():
                if raw is None:
                    rows.append(None)
                    continue
                try:
                    item, read = read_item(raw, mode, strict)
                    rows.append({"nodes": nodes_of(item), "read": read, "error": None})
                except CodecError as e:
                    rows.append({"nodes": None, "read": None, "error": str(e)})
            yield pa.array(rows, kind)

    return run(data)


def as_python(item: Item, kind: T.DataType) -> Any:
    """An item as a value of a Spark type; what doesn't fit is null."""
    if isinstance(kind, T.StructType):
        if item.name != "object":
            return None
        by_tag: dict[int, Item] = {}
        for child in item.items:
            by_tag.setdefault(child.tag, child)
        return {f.name: as_python(by_tag[t], f.dataType) if (t := tag_of(f, i)) in by_tag else None for i, f in enumerate(kind.fields)}
    if isinstance(kind, T.ArrayType):
        return [as_python(x, kind.elementType) for x in item.items] if item.name == "array" else None
    if isinstance(kind, T.MapType):
        pairs = [as_python(x, T.StructType([T.StructField("k", kind.keyType, metadata={"tag": 0}), T.StructField("v", kind.valueType, metadata={"tag": 1})])) for x in item.items]
        return [(p["k"], p["v"]) for p in pairs if p] if item.name == "object" else None
    if item.name != wire_name(kind):
        return None
    return Decimal(item.value) if isinstance(kind, T.DecimalType) else item.value


def read_flat(column: pa.Array, kind: T.StructType, arrow: pa.DataType) -> tuple[pa.Array, np.ndarray] | None:
    """Rows of objects that hold just kind's scalar fields, in order, in logical mode, and which rows are so. None if kind isn't flat, or text isn't UTF-8."""
    names = [None if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType | T.NullType) else wire_name(f.dataType) for f in kind.fields]
    if not names or None in names:
        return None
    data, start, end, valid = vector.spans(column)
    _, at, status = vector.varints(data, start, end)
    ok = valid & (status == vector.READ) & (at < end)
    at = np.where(ok, at, 0)
    ok &= data[at] == CODES["object"]
    size, at, status = vector.varints(data, at + 1, end)
    stop = at + vector.sizes(size)
    ok &= (status == vector.READ) & (stop <= end)
    found = []
    for i, (f, name) in enumerate(zip(kind.fields, names, strict=True)):
        at, stop = np.where(ok, at, 0), np.where(ok, stop, 0)
        tag, at, status = vector.varints(data, at, stop)
        ok &= (status == vector.READ) & (tag == np.uint64(tag_of(f, i))) & (at < stop)
        at = np.where(ok, at, 0)
        code = data[at]
        size, at, status = vector.varints(data, at + 1, stop)
        size = vector.sizes(size)
        ok &= (status == vector.READ) & (at + size <= stop)
        null = (code == 0) & (size == 0)
        right = code == CODES[name]
        if name in DTYPES:
            right &= size == DTYPES[name].itemsize
        elif name == "bool":
            right &= size == 1
        else:  # eight bytes may be the header of a sharded field
            eight = size == 8
            head = vector.numbers(data, np.where(ok & eight, at, 0), np.dtype("<u8"))
            right &= ~(eight & (head > LARGE))
        ok &= null | right
        found.append((name, at, size, null))
        at = at + size
    ok &= at == stop
    columns = []
    for field_type, (name, at, size, null) in zip(arrow, found, strict=True):
        on = ok & ~null
        at = np.where(on, at, 0)
        if name in ("string", "bytes"):
            values = vector.pieces(data, at, size, on)
        elif name == "bool":
            values = pa.array(data[at] != 0, mask=~on)
        else:
            values = pa.array(vector.numbers(data, at, DTYPES[name]), mask=~on)
        try:
            columns.append(values.cast(field_type.type))
        except pa.ArrowInvalid:
            return None
    return pa.StructArray.from_arrays(columns, fields=list(arrow), mask=pa.array(~valid)), ok | ~valid


def decode_value(data: Column, kind: T.DataType, mode: str = "logical", strict: bool = True, on_error: str = "fail") -> Column:
    """The first item of BINARY as a Spark type. on_error: "fail", or "null" for bytes that can't be read."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def walked(rows: list[bytes | None]) -> pa.Array:
        out = []
        for raw in rows:
            try:
                out.append(None if raw is None else as_python(read_item(raw, mode, strict)[0], kind))
            except CodecError:
                if on_error == "fail":
                    raise
                out.append(None)
        return pa.array(out, arrow)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            read = read_flat(batch, kind, arrow) if mode == "logical" and isinstance(kind, T.StructType) else None
            if read is None:
                yield walked(batch.to_pylist())
                continue
            flat, done = read
            rest = np.flatnonzero(~done)
            if len(rest):
                place = np.arange(len(batch))
                place[rest] = len(batch) + np.arange(len(rest))
                flat = pa.concat_arrays([flat, walked(batch.take(pa.array(rest)).to_pylist())]).take(pa.array(place))
            yield flat

    return run(data)


# -- packed batches --------------------------------------------------------------------------------


def decode_batch(data: Column, name: str) -> Column:
    """array<T> of the packed numbers in BINARY; numpy reads them without a loop over elements."""
    if name not in DTYPES:
        raise CodecError("Unsupported type for batch processing")
    spark, dtype = NUMBERS[name].spark, DTYPES[name]
    arrow = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "tinyint": pa.int8(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}[spark]

    @F.arrow_udf(f"array<{spark}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.to_pylist()
            for raw in rows:
                if raw is not None and len(raw) % dtype.itemsize:
                    raise CodecError(f"Invalid data length for batch decoding: must be a multiple of {dtype.itemsize}")
            flat = np.frombuffer(b"".join(x or b"" for x in rows), dtype)
            values = pa.array([Decimal(int(x)) for x in flat], arrow) if name == "u64" else pa.array(flat).cast(arrow)
            ends = np.cumsum([0, *(len(x or b"") // dtype.itemsize for x in rows)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in rows]))

    return run(data)


def encode_batch(values: Column, name: str) -> Column:
    """BINARY of packed numbers: what decode_batch() reads."""
    return F.unhex(F.array_join(F.transform(values, lambda x: scalars.encode_hex(x, name)), ""))


def encode_batch_fitting(values: Column, name: str) -> Column:
    """struct<type tinyint, data binary>: packed integers in the narrowest type from `name` on that holds all of them."""
    ranged = bind(values, lambda v: F.struct(v.alias("values"), F.array_min(v).alias("low"), F.array_max(v).alias("high")))
    typed = bind(ranged, lambda r: F.struct(r["values"].alias("values"), scalars.fitting(r["low"], r["high"], name).alias("of")))

    def put(b: Column) -> Column:
        bits, widths = F.transform(b["values"], lambda x: scalars.integer_bits(x, name)), F.array_repeat(b["of"]["width"], F.size(b["values"]))
        digits = F.zip_with(bits, widths, scalars.low_bytes_hex)
        return F.struct(b["of"]["type"].alias("type"), F.unhex(F.array_join(digits, "")).alias("data"))

    return bind(typed, put)


def decode_batch_fitting(packed: Column, name: str) -> Column:
    """array<bigint>, or of DECIMAL(20,0) if unsigned, of what encode_batch_fitting() wrote: each row's own type is read."""
    unsigned = scalars.NUMBERS[name].kind == "u"
    wide, arrow = (np.dtype("<u8"), pa.decimal128(20, 0)) if unsigned else (np.dtype("<i8"), pa.int64())

    @F.arrow_udf("array<decimal(20,0)>" if unsigned else "array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            types, data = batch.flatten()
            rows = data.to_pylist()
            codes = types.fill_null(CODES[name]).to_numpy(zero_copy_only=False)
            sizes = np.zeros(len(rows), np.int64)
            parts = []
            for code in np.unique(codes):
                kind = NAMES.get(int(code))
                if kind not in DTYPES or DTYPES[kind].kind != wide.kind:
                    raise CodecError("Unsupported type for batch processing")
                own = np.flatnonzero(codes == code)
                lengths = np.array([len(rows[i] or b"") for i in own])
                if (lengths % DTYPES[kind].itemsize).any():
                    raise CodecError(f"Invalid data length for batch decoding: must be a multiple of {DTYPES[kind].itemsize}")
                sizes[own] = lengths // DTYPES[kind].itemsize
                parts.append((code, np.frombuffer(b"".join(rows[i] or b"" for i in own), DTYPES[kind])))
            flat = np.zeros(sizes.sum(), wide)
            of = np.repeat(codes, sizes)
            for code, numbers in parts:
                flat[of == code] = numbers
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(arrow), mask=pa.array([x is None for x in rows]))

    return run(packed)


# -- blocks ----------------------------------------------------------------------------------------

NESTED, COMPRESSED, ENCRYPTED = 1, 2, 4


def encode_block(tag: Column, flags: Column, value: Column) -> Column:
    """BINARY block: tag in two bytes, high first, flags, varint length, value. A nested block's value is its blocks' encodings, concatenated."""
    head = F.concat(F.lpad(F.hex(tag.cast("int").bitwiseAND(F.lit(0xFFFF)).cast("long")), 4, "0"), varint.byte_hex(flags.cast("long")))
    return F.unhex(F.concat(head, varint.encode_hex(F.octet_length(value).cast("long")), F.hex(value)))


def read_block(data: bytes, at: int = 0, depth: int = 0, end: int | None = None) -> tuple[dict, int]:
    """The block at a place, and where it ends; it lies before end."""
    end = len(data) if end is None else end
    if end < at + 3:
        raise CodecError("Incomplete data for block")
    tag, flags = int.from_bytes(data[at : at + 2], "big"), data[at + 2]
    if flags & ~7:
        raise CodecError(f"Unknown flags: {flags}")
    if depth > MOST_NESTED:
        raise CodecError(f"Maximum nesting depth ({MOST_NESTED}) exceeded")
    length, start = read_varint(data, at + 3)
    if start + length > end:
        raise CodecError("Incomplete data for Value")
    block = {"tag": tag, "flags": flags, "length": length, "value": data[start : start + length], "nested": []}
    inner = start
    while flags & NESTED and inner < start + length:
        child, inner = read_block(data, inner, depth + 1, start + length)
        block["nested"].append(child)
    return block, start + length


def decode_blocks(data: Column) -> Column:
    """array<struct<depth, tag, flags, value>> of a block and the blocks in it, parents first; null if it can't be read."""
    kind = pa.list_(pa.struct([("depth", pa.int32()), ("tag", pa.int32()), ("flags", pa.int16()), ("value", pa.binary())]))

    @F.arrow_udf("array<struct<depth:int,tag:int,flags:smallint,value:binary>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for raw in batch.to_pylist():
                try:
                    stack, out = [(read_block(raw)[0], 0)] if raw is not None else [], []
                except CodecError:
                    rows.append(None)
                    continue
                while stack:
                    block, depth = stack.pop()
                    out.append({"depth": depth, "tag": block["tag"], "flags": block["flags"], "value": block["value"]})
                    stack.extend((b, depth + 1) for b in reversed(block["nested"]))
                rows.append(out if raw is not None else None)
            yield pa.array(rows, kind)

    return run(data)


# -- encoding of item trees ------------------------------------------------------------------------


def write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def write_item(item: Item) -> bytes:
    """The bytes of an item tree, children first; nesting may be of any depth."""
    done: dict[int, bytes] = {}
    stack = [(item, False)]
    while stack:
        at, ready = stack.pop()
        if at.name in ("array", "object") and not ready:
            stack.append((at, True))
            stack.extend((c, False) for c in at.items)
            continue
        value = b"".join(done.pop(id(c)) for c in at.items) if ready else _value_bytes(at) or b""
        head = write_varint(at.tag) + bytes([CODES[at.name]])
        if at.name in ("bytes", "string") and len(value) > LARGE:
            parts = [len(value).to_bytes(8, "little"), *(value[i : i + LARGE] for i in range(0, len(value), LARGE))]
            done[id(at)] = b"".join(head + write_varint(len(p)) + p for p in parts)
        else:
            done[id(at)] = head + write_varint(len(value)) + value
    return done[id(item)]
