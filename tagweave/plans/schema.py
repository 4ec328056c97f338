"""Schemas of tagged items: types, text form, registry, defaults, validation and mapping from JSON.

A schema lives on the driver and is small; what runs on data are Column expressions made from it, or
one Arrow UDF where values nest.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.errors import SchemaError
from tagweave.operators.codec import Item, write_item

#: Bounds of the integer types.
RANGES = {f"{s}int{b}".replace("sint", "int"): ((0, 2**b - 1) if s == "u" else (-(2 ** (b - 1)), 2 ** (b - 1) - 1)) for s in "us" for b in (8, 16, 32, 64)}
FLOAT32_MAX = 3.4028234663852886e38
_WIRE = {"null": "null", "boolean": "bool", "uint8": "u8", "uint16": "u16", "uint32": "u32", "uint64": "u64", "int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64", "float32": "f32", "float64": "f64", "binary": "bytes", "string": "string", "array": "array", "object": "object", "map": "object", "union": "object"}
_SPARK = {"null": T.NullType(), "boolean": T.BooleanType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "binary": T.BinaryType(), "string": T.StringType()}


@dataclass(frozen=True)
class SchemaType:
    """name: one of _WIRE's; items: of an array; key and value: of a map; members: of a union; fields: of an object."""

    name: str
    items: SchemaType | None = None
    key: SchemaType | None = None
    value: SchemaType | None = None
    members: tuple[SchemaType, ...] = ()
    fields: tuple[SchemaField, ...] = ()

    @property
    def wire(self) -> str:
        return _WIRE[self.name]

    @property
    def is_integer(self) -> bool:
        return self.name in RANGES

    @property
    def is_float(self) -> bool:
        return self.name in ("float32", "float64")

    @property
    def is_numeric(self) -> bool:
        return self.is_integer or self.is_float

    @property
    def is_complex(self) -> bool:
        return self.name in ("array", "object", "map", "union")

    def spark(self) -> T.DataType:
        """The Spark type; a union is a VARIANT, and fields keep their tags as metadata."""
        if self.name == "array":
            return T.ArrayType(self.items.spark())
        if self.name == "map":
            return T.MapType(self.key.spark(), self.value.spark())
        if self.name == "object":
            return T.StructType([T.StructField(f.name, f.type.spark(), metadata={"tag": f.tag}) for f in self.fields])
        return T.VariantType() if self.name == "union" else _SPARK[self.name]

    def field_by_tag(self, tag: int) -> SchemaField | None:
        return next((f for f in self.fields if f.tag == tag), None)

    def field_by_name(self, name: str) -> SchemaField | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class Constraints:
    """minimum and maximum of numbers; lengths of strings and binaries (bytes) and arrays (items); pattern of strings."""

    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    compress: bool = False
    encrypt: bool = False
    index: bool = False
    custom: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class SchemaField:
    name: str
    tag: int
    type: SchemaType
    required: bool = False
    default: Any = None
    description: str | None = None
    constraints: Constraints = Constraints()


@dataclass(frozen=True, order=True)
class Version:
    major: int = 1
    minor: int = 0
    patch: int = 0

    def compatible(self, other: Version) -> bool:
        return self.major == other.major

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


@dataclass(frozen=True)
class Schema:
    id: str
    name: str
    type: SchemaType
    version: Version = Version()
    description: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


def tag_from_name(name: str) -> int:
    """An unsigned 64-bit tag for a field without one: XXH64 of its name with seed 42, as Spark's xxhash64() gives."""
    import xxhash

    return xxhash.xxh64(name.encode(), seed=42).intdigest()


# -- text form -------------------------------------------------------------------------------------


class Parser:
    """Reads schema documents: JSON with id, name, and type or properties. mappings: types by names of one's own."""

    def __init__(self, mappings: dict[str, SchemaType] | None = None):
        self.mappings = dict(mappings or {})

    def parse(self, document: str | dict) -> Schema:
        doc = json.loads(document) if isinstance(document, str) else document
        for key in ("id", "name"):
            if not isinstance(doc.get(key), str):
                raise SchemaError(f"missing or invalid '{key}'")
        if "type" not in doc and "properties" not in doc:
            raise SchemaError("needs 'type' or 'properties'")
        kind = self.type(doc) if "type" in doc else self.object(doc)
        return Schema(doc["id"], doc["name"], kind, self.version(doc.get("version")), doc.get("description"), doc.get("metadata") or {})

    @staticmethod
    def version(of: Any) -> Version:
        if of is None:
            return Version()
        if isinstance(of, dict):
            return Version(*(int(of.get(k, d)) for k, d in (("major", 1), ("minor", 0), ("patch", 0))))
        if not isinstance(of, str) or not re.fullmatch(r"[0-9]+(\.[0-9]+){0,2}", of):
            raise SchemaError(f"invalid version: {of}")
        return Version(*map(int, of.split(".")), *[0] * (2 - of.count(".")))

    def type(self, spec: Any) -> SchemaType:
        if isinstance(spec, str):
            spec = {"type": spec}
        if isinstance(spec, list):
            return SchemaType("union", members=tuple(map(self.type, spec)))
        if not isinstance(spec, dict) or "type" not in spec:
            raise SchemaError("a type is a name, a list, or an object with 'type'")
        name, form = spec["type"], spec.get("format")
        if isinstance(name, dict):
            return self.type(name)
        if isinstance(name, list):
            return self.type(name)
        if name in self.mappings:
            return self.mappings[name]
        if name in ("null", "boolean"):
            return SchemaType(name)
        if name == "integer":
            if form is not None and form not in RANGES:
                raise SchemaError(f"unknown integer format: {form}")
            return SchemaType(form or "int32")
        if name == "number":
            known = {None: "float64", "float": "float32", "double": "float64", "float32": "float32", "float64": "float64"}
            if form not in known:
                raise SchemaError(f"unknown number format: {form}")
            return SchemaType(known[form])
        if name == "string":
            return SchemaType("binary" if form in ("binary", "bytes") else "string")
        if name == "array":
            if "items" not in spec:
                raise SchemaError("an array needs 'items'")
            return SchemaType("array", items=self.type(spec["items"]))
        if name == "object":
            return self.object(spec)
        if name == "map":
            keys, values = spec.get("keys", "string"), spec.get("values")
            if values is None:
                raise SchemaError("a map needs 'values'")
            return SchemaType("map", key=self.type(keys), value=self.type(values))
        if name == "union":
            return SchemaType("union", members=tuple(map(self.type, spec.get("types", []))))
        raise SchemaError(f"Unknown type: {name}")

    def object(self, spec: dict) -> SchemaType:
        out = []
        for name, p in (spec.get("properties") or {}).items():
            rules = Constraints(p.get("minimum"), p.get("maximum"), p.get("minLength"), p.get("maxLength"), p.get("pattern"), bool(p.get("compress")), bool(p.get("encrypt")), bool(p.get("index")), p.get("custom") or {})
            out.append(SchemaField(name, int(p["tag"]) if "tag" in p else tag_from_name(name), self.type(p), bool(p.get("required", False)), p.get("default"), p.get("description"), rules))
        return SchemaType("object", fields=tuple(out))


class Registry:
    """Schemas by id and version. The latest is the last registered, unless by_version is asked for."""

    def __init__(self):
        self._all: dict[str, list[Schema]] = {}

    def register(self, schema: Schema) -> None:
        kept = [s for s in self._all.get(schema.id, []) if s.version != schema.version]
        self._all[schema.id] = [*kept, schema]

    def latest(self, schema_id: str, by_version: bool = False) -> Schema:
        if not self._all.get(schema_id):
            raise SchemaError(f"no schema {schema_id}")
        return max(self._all[schema_id], key=lambda s: s.version) if by_version else self._all[schema_id][-1]

    def get(self, schema_id: str, version: Version) -> Schema:
        for s in self._all.get(schema_id, []):
            if s.version == version:
                return s
        raise SchemaError(f"no schema {schema_id} {version}")

    def versions(self, schema_id: str) -> list[Version]:
        return sorted(s.version for s in self._all.get(schema_id, []))


# -- numbers ---------------------------------------------------------------------------------------


def _is_real(value: Column) -> Column:
    return F.typeof(value).isin("float", "double")


def in_range(value: Column, name: str) -> Column:
    """Whether a number is within a type's range, fractions included; zero is within every one. Reals are compared as such, and other numbers exactly."""
    if name == "float64":
        return value.isNotNull()
    if name == "float32":
        return value.cast("double").between(F.lit(-FLOAT32_MAX), F.lit(FLOAT32_MAX))
    low, high = RANGES[name]
    real = value.cast("double")
    below = real <= float(high) if high < 1 << 53 else real < float(high + 1)  # no double lies between
    exact = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    return F.when(_is_real(value), (real >= float(low)) & below).otherwise((F.floor(value) >= exact(low)) & (F.ceil(value) <= exact(high)))


def to_number(value: Column, name: str) -> Column:
    """A number as a type's value: fractions are cut off, null if out of range."""
    if name in ("float32", "float64"):
        return F.when(in_range(value, name), value.try_cast(_SPARK[name]))
    cut = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    large = _is_real(value) & (F.abs(value) >= float(1 << 53))  # whole, and perhaps beyond a long
    upper = (value.cast("double") - float(1 << 63)).try_cast("bigint").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    whole = F.when(large & (value >= float(1 << 63)), upper).otherwise(cut.cast("decimal(38,0)")) if name == "uint64" else cut
    return F.when(F.when(large, in_range(value, name)).otherwise(in_range(cut, name)), whole.try_cast(_SPARK[name]))


# -- defaults --------------------------------------------------------------------------------------

STRATEGIES = ("none", "required", "all", "recursive", "custom")


def zero(kind: SchemaType) -> Any:
    """A type's value where there is none: zero, empty, or the first member's."""
    if kind.name == "union":
        if not kind.members:
            raise SchemaError("an empty union has no default")
        return zero(kind.members[0])
    if kind.is_numeric:
        return 0.0 if kind.is_float else 0
    return {"null": None, "boolean": False, "string": "", "binary": b"", "array": [], "map": {}, "object": {}}[kind.name]


def default_of(f: SchemaField, strategy: str, custom: dict[str, Any] | None = None) -> Any:
    """What an absent field gets: None for nothing."""
    if strategy not in STRATEGIES:
        raise SchemaError(f"unknown strategy: {strategy}")
    if strategy == "none":
        return None
    if strategy == "custom":
        return (custom or {}).get(f.name)
    if f.default is not None:
        return f.default
    if strategy == "required":
        return zero(f.type) if f.required else None
    return zero(f.type)


def with_defaults(columns: dict[str, Column], kind: SchemaType, strategy: str, custom: dict[str, Any] | None = None) -> list[Column]:
    """Columns of an object, absent ones (null) filled in; "recursive" also fills in the objects and arrays of objects within."""

    def filled(value: Column, f: SchemaField) -> Column:
        if strategy == "recursive" and f.type.name == "object":
            inner = F.struct(*with_defaults({g.name: value[g.name] for g in f.type.fields}, f.type, strategy))
            return inner if f.required or f.default is not None else F.when(value.isNotNull(), inner)
        if strategy == "recursive" and f.type.name == "array" and f.type.items.name == "object":
            fields = f.type.items.fields
            value = F.transform(value, lambda x: F.when(x.isNotNull(), F.struct(*with_defaults({g.name: x[g.name] for g in fields}, f.type.items, strategy))))
        default = default_of(f, strategy, custom)
        if default is None or default == {}:
            return value
        kind = f.type.spark()
        lit = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
        return F.coalesce(value, lit)

    return [filled(columns.get(f.name, F.lit(None).cast(f.type.spark())), f).alias(f.name) for f in kind.fields]


# -- validation ------------------------------------------------------------------------------------


_NOTHING = "array<string>"


def _say(bad: Column, what: Column | str) -> Column:
    return F.when(bad, F.array(F.lit(what) if isinstance(what, str) else what)).otherwise(F.array().cast(_NOTHING))


def _shape(value: Column) -> Column:
    """A variant's own type: VOID, BOOLEAN, BIGINT, DOUBLE or DECIMAL(...), STRING, ARRAY<...>, OBJECT<...>."""
    return F.schema_of_variant(value)


def fits(value: Column, kind: SchemaType, depth: int = 0) -> Column:
    """Whether a VARIANT value is of a type: numbers by their range, what nests by all that it holds, a union by any of its members."""
    if depth > 32:
        raise SchemaError("Maximum validation depth (32) exceeded")
    shape, name = _shape(value), kind.name
    if name == "union":
        out = F.lit(False)
        for member in kind.members:
            out = out | fits(value, member, depth)
        return F.coalesce(out, F.lit(False))
    if name == "null":
        return F.coalesce(shape == "VOID", F.lit(False))
    if name == "boolean":
        return F.coalesce(shape == "BOOLEAN", F.lit(False))
    if kind.is_integer:
        return F.coalesce((shape == "BIGINT") & in_range(F.try_variant_get(value, "$", "decimal(38,0)"), name), F.lit(False))
    if kind.is_float:
        return F.coalesce(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & in_range(F.try_variant_get(value, "$", "double"), name), F.lit(False))
    if name in ("string", "binary"):
        right = shape == "STRING"
        return F.coalesce(right & F.try_to_binary(F.try_variant_get(value, "$", "string"), F.lit("base64")).isNotNull() if name == "binary" else right, F.lit(False))
    if name == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce(shape.startswith("ARRAY") & F.forall(items, lambda x: fits(x, kind.items, depth + 1)), F.lit(False))
    inside = F.try_variant_get(value, "$", "map<string,variant>")
    if name == "map":
        return F.coalesce(shape.startswith("OBJECT") & F.forall(F.map_values(inside), lambda x: fits(x, kind.value, depth + 1)), F.lit(False))
    out = shape.startswith("OBJECT")
    for f in kind.fields:
        own = F.try_variant_get(value, f"$.{f.name}", "variant")
        out = out & (own.isNotNull() & fits(own, f.type, depth + 1) if f.required else own.isNull() | fits(own, f.type, depth + 1))
    return F.coalesce(out, F.lit(False))


def value_violations(value: Column, kind: SchemaType, at: Column | str, depth: int = 0) -> Column:
    """array<string>: what is wrong with one value, null for none: numbers out of range, elements of arrays, keys and values of maps, fields of objects, and unions (VARIANT) of no member's type."""
    if depth > 32:
        raise SchemaError("Maximum validation depth (32) exceeded")
    path = F.lit(at) if isinstance(at, str) else at
    none, name = F.array().cast(_NOTHING), kind.name
    said = lambda what: F.concat(path, F.lit(f": {what}"))
    if kind.is_numeric:
        return _say(~in_range(value, name), said(f"out of range for {name}"))
    if name == "array":
        if not (kind.items.is_numeric or kind.items.is_complex):
            return none
        each = lambda x, i: value_violations(x, kind.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1)
        return F.coalesce(F.flatten(F.transform(value, each)), none)
    if name == "map":
        entry = lambda e: F.concat(value_violations(e["key"], kind.key, F.concat(path, F.lit(" key")), depth + 1), value_violations(e["value"], kind.value, F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]")), depth + 1))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), entry)), none)
    if name == "union":
        return _say(value.isNotNull() & ~fits(value, kind, depth), said("does not match any type in union"))
    if name == "object":
        inner = _fields({g.name: value[g.name] for g in kind.fields}, kind, F.concat(path, F.lit(".")), depth + 1)
        return F.when(value.isNotNull(), inner).otherwise(none)
    return none


def _fields(columns: dict[str, Column], kind: SchemaType, path: Column, depth: int) -> Column:
    found: list[Column] = []
    for f in kind.fields:
        at = F.concat(path, F.lit(f.name))
        said = lambda what, at=at: F.concat(at, F.lit(f": {what}"))
        if f.name not in columns:
            if f.required:
                found.append(F.array(said("required field is missing")))
            continue
        value, c = columns[f.name], f.constraints
        if f.required:
            found.append(_say(value.isNull(), said("required field is missing")))
        found.append(value_violations(value, f.type, at, depth))
        if f.type.is_numeric:
            if c.minimum is not None:
                found.append(_say(value < F.lit(c.minimum), said(f"less than minimum {c.minimum}")))
            if c.maximum is not None:
                found.append(_say(value > F.lit(c.maximum), said(f"greater than maximum {c.maximum}")))
        if f.type.name in ("string", "binary", "array"):
            size = F.size(value) if f.type.name == "array" else F.octet_length(value)
            if c.min_length is not None:
                found.append(_say(value.isNotNull() & (size < c.min_length), said(f"shorter than {c.min_length}")))
            if c.max_length is not None:
                found.append(_say(value.isNotNull() & (size > c.max_length), said(f"longer than {c.max_length}")))
        if f.type.name == "string" and c.pattern is not None:
            found.append(_say(~value.rlike(c.pattern), said(f"does not match {c.pattern}")))
    return F.flatten(F.array(*found)) if found else F.array().cast(_NOTHING)


def violations(columns: dict[str, Column], kind: SchemaType, path: str = "", depth: int = 0) -> Column:
    """array<string>: what is wrong with an object's columns, at any depth; empty if nothing. Lengths of strings are bytes, and of arrays items."""
    return _fields(columns, kind, F.lit(path), depth)


def unknown_names(names: Column, kind: SchemaType) -> Column:
    """Of an array of names, those that aren't fields of the object."""
    return F.array_except(names, F.array(*(F.lit(f.name) for f in kind.fields)).cast("array<string>"))


# -- mapping from JSON -----------------------------------------------------------------------------


def to_item(value: Any, kind: SchemaType, tag: int = 0, keep_unknown: bool = False, defaults: str = "none") -> Item:
    """A JSON value as an item of a schema type. Array elements' tags are their places; map entries are objects of key (0) and value (1)."""
    name = kind.name

    def wrong() -> SchemaError:
        return SchemaError(f"{json.dumps(value)[:60]} is no {name}")

    if name == "union":
        for member in kind.members:
            try:
                return to_item(value, member, tag, keep_unknown, defaults)
            except SchemaError:
                continue
        raise wrong()
    if name == "null":
        if value is not None:
            raise wrong()
        return Item(tag, "null")
    if name == "boolean":
        if not isinstance(value, bool):
            raise wrong()
        return Item(tag, "bool", value)
    if kind.is_numeric:
        if isinstance(value, bool) or not isinstance(value, int | float | Decimal) or (kind.is_integer and value != int(value)):
            raise wrong()
        low, high = RANGES.get(name, (-FLOAT32_MAX, FLOAT32_MAX) if name == "float32" else (-float("inf"), float("inf")))
        if not low <= value <= high:
            raise SchemaError(f"{value} is out of range for {name}")
        return Item(tag, kind.wire, int(value) if kind.is_integer else float(value))
    if name == "string":
        if not isinstance(value, str):
            raise wrong()
        return Item(tag, "string", value)
    if name == "binary":
        try:
            return Item(tag, "bytes", base64.b64decode(value, validate=True))
        except (binascii.Error, TypeError, ValueError):
            raise wrong() from None
    if name == "array":
        if not isinstance(value, list):
            raise wrong()
        return Item(tag, "array", items=[to_item(x, kind.items, i, keep_unknown, defaults) for i, x in enumerate(value)])
    if not isinstance(value, dict):
        raise wrong()
    if name == "map":
        key_of = lambda k: k if kind.key.name == "string" else json.loads(k)
        return Item(tag, "object", items=[Item(i, "object", items=[to_item(key_of(k), kind.key, 0), to_item(v, kind.value, 1, keep_unknown, defaults)]) for i, (k, v) in enumerate(value.items())])
    items = []
    for f in kind.fields:
        given = value.get(f.name, default_of(f, defaults) if f.name not in value else None)
        if given is None and f.type.name != "null":
            if f.required and f.name not in value:
                raise SchemaError(f"required field {f.name} is missing")
            continue
        items.append(to_item(given, f.type, f.tag, keep_unknown, defaults))
    if keep_unknown:
        known = {f.name for f in kind.fields}
        items += [to_item(v, type_of(v), tag_from_name(k), True) for k, v in value.items() if k not in known]
    return Item(tag, "object", items=items)


def type_of(value: Any) -> SchemaType:
    """The type of one JSON value: the smallest signed integer, float64, arrays by their first element, objects by their fields."""
    if value is None:
        return SchemaType("null")
    if isinstance(value, bool):
        return SchemaType("boolean")
    if isinstance(value, int):
        return SchemaType(next((n for n in ("int8", "int16", "int32", "int64", "uint64") if RANGES[n][0] <= value <= RANGES[n][1]), "float64"))
    if isinstance(value, float):
        return SchemaType("float64")
    if isinstance(value, str):
        return SchemaType("string")
    if isinstance(value, list):
        return SchemaType("array", items=type_of(value[0]) if value else SchemaType("null"))
    return SchemaType("object", fields=tuple(SchemaField(k, tag_from_name(k), type_of(v)) for k, v in value.items()))


def json_to_items(column: Column, kind: SchemaType, keep_unknown: bool = False, defaults: str = "none", on_error: str = "fail") -> Column:
    """BINARY items of JSON strings. on_error: "fail", or "null" for values that don't fit."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def of(text: str) -> bytes | None:
            try:
                return write_item(to_item(json.loads(text), kind, 0, keep_unknown, defaults))
            except (SchemaError, json.JSONDecodeError):
                if on_error == "fail":
                    raise
                return None

        for batch in batches:
            yield pa.array([of(x.as_py()) if x.is_valid else None for x in batch], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(column)


Mapper = Callable[[Column, SchemaType], Column]
