"""Schemas inferred from JSON: one pass that sums up every path of every value, and a driver that reads the sums.

Each task keeps one row for each path and kind of value; sums of all tasks are merged by a shuffle of
those few rows. All values count, none are sampled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.plans.schema import FLOAT32_MAX, RANGES, Schema, SchemaError, SchemaField, SchemaType, tag_from_name

_BASE64 = re.compile(r"[A-Za-z0-9+/=]*")
_SUMS = "path string, kind string, n long, low double, high double, fractional boolean, base64 boolean"
_LIMIT = 2.0**63


#: Paths that a task sums up before it passes them on; paths of a schema at most, since its document is made on the driver.
MOST_HELD, MOST_PATHS = 100_000, 100_000


def kinds_of(value: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, Any]]:
    """Path, kind and value of a JSON value and all values in it; "[]" is any element."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        yield at, kind, v
        if kind == "array":
            stack.extend(((*at, "[]"), x) for x in v)
        elif kind == "object":
            stack.extend(((*at, "." + k), x) for k, x in v.items())


def sums(df: DataFrame, column: str) -> DataFrame:
    """A row for each path and kind: how often, the numbers' bounds, whether any is a fraction, whether all strings look like base64. Text that isn't JSON counts as kind "invalid"."""

    def told(found: dict[tuple, list]) -> pa.RecordBatch:
        rows = [(json.dumps(p), k, *s[:1], *(float(x) if x is not None else None for x in s[1:3]), *s[3:]) for (p, k), s in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SUMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            if len(found) > MOST_HELD:  # parts of sums are summed up later
                yield told(found)
                found = {}
            for cell in batch.column(0):
                if not cell.is_valid:
                    continue
                try:
                    value = json.loads(cell.as_py())
                except json.JSONDecodeError:
                    found.setdefault(((), "invalid"), [0, None, None, False, True])[0] += 1
                    continue
                for path, kind, v in kinds_of(value):
                    s = found.setdefault((path, kind), [0, None, None, False, True])
                    s[0] += 1
                    if kind == "number":
                        s[1] = v if s[1] is None else min(s[1], v)
                        s[2] = v if s[2] is None else max(s[2], v)
                        s[3] = s[3] or isinstance(v, float)
                    elif kind == "string":
                        s[4] = s[4] and len(v.encode()) > 8 and bool(_BASE64.fullmatch(v))
        yield told(found)

    rows = df.select(F.col(column).cast("string")).mapInArrow(run, _SUMS)
    return rows.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("fractional").alias("fractional"), F.bool_and("base64").alias("base64"))


def number_type(low: float, high: float, fractional: bool, specific: bool = True) -> SchemaType:
    if fractional:
        return SchemaType("float32" if -FLOAT32_MAX <= low and high <= FLOAT32_MAX and specific else "float64")
    if not specific:
        return SchemaType("float64")
    names = ("int8", "int16", "int32", "int64") if low < 0 else ("uint8", "uint16", "uint32", "uint64")
    return SchemaType(next((n for n in names if RANGES[n][0] <= low and high <= RANGES[n][1]), names[-1]))


def infer(df: DataFrame, column: str, schema_id: str, name: str, min_samples: int = 1, required_share: float = 0.9, specific: bool = True) -> Schema:
    """The schema of a column of JSON strings. Differing kinds make a union in the order of their names; a field is required if at least required_share of the objects have it."""
    if df.where(F.col(column).isNotNull()).limit(min_samples).count() < min_samples:
        raise SchemaError(f"needs at least {min_samples} samples")
    by_path: dict[tuple[str, ...], dict[str, Any]] = {}
    for r in sums(df, column).toLocalIterator():  # a row for each path of the schema
        if len(by_path) > MOST_PATHS:
            raise SchemaError(f"more than {MOST_PATHS} paths: names in these objects are data")
        by_path.setdefault(tuple(json.loads(r.path)), {})[r.kind] = r
    children: dict[tuple[str, ...], list[str]] = {}
    for path in by_path:
        if path:
            children.setdefault(path[:-1], []).append(path[-1])

    def of_kind(path: tuple[str, ...], kind: str) -> SchemaType:
        r = by_path[path][kind]
        if kind == "number":
            return number_type(r.low, r.high, r.fractional, specific)
        if kind == "string":
            return SchemaType("binary" if r.base64 else "string")
        if kind == "array":
            inner = (*path, "[]")
            return SchemaType("array", items=of(inner) if inner in by_path else SchemaType("null"))
        if kind == "object":
            keys = sorted(k for k in children.get(path, []) if k != "[]")
            fields = []
            for k in keys:
                present = sum(x.n for x in by_path[(*path, k)].values())
                fields.append(SchemaField(k[1:], tag_from_name(k[1:]), of((*path, k)), required=present >= required_share * r.n))
            return SchemaType("object", fields=tuple(fields))
        return SchemaType(kind)

    def of(path: tuple[str, ...]) -> SchemaType:
        kinds = sorted(k for k in by_path[path] if k != "invalid")
        if not kinds:
            raise SchemaError("no value is JSON")
        return of_kind(path, kinds[0]) if len(kinds) == 1 else SchemaType("union", members=tuple(of_kind(path, k) for k in kinds))

    return Schema(schema_id, name, of(()))


# -- of typed columns ------------------------------------------------------------------------------


def number_type_name(value: Column) -> Column:
    """Aggregate: the narrowest type of a numeric column, by name."""
    low, high = F.min(value), F.max(value)
    fractional = F.bool_or(value.cast("double") != F.floor(value.cast("double")))
    out = F.when(fractional, F.when((low >= -FLOAT32_MAX) & (high <= FLOAT32_MAX), "float32").otherwise("float64"))
    for names in (("int8", "int16", "int32"), ("uint8", "uint16", "uint32")):
        for n in names:
            fits = (low < 0 if names[0] == "int8" else low >= 0) & (low >= RANGES[n][0]) & (high <= RANGES[n][1])
            out = out.when(fits, n)
    return out.when(low < 0, "int64").when(low.isNotNull(), "uint64")


def string_kind(value: Column) -> Column:
    """Aggregate: "binary" if every string has more than eight bytes, all of the base64 alphabet, else "string"."""
    return F.when(F.bool_and((F.octet_length(value) > 8) & value.rlike("^[A-Za-z0-9+/=]*$")), "binary").otherwise("string")
