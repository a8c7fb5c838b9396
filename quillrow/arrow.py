"""Between Arrow arrays and the wire codec's physical values."""

from __future__ import annotations

import pyarrow as pa

from quillrow.schema import Array, Enum, Fixed, Logical, Map, Primitive, Record, Schema, Union, union_shape

_PRIMITIVE = {
    "null": pa.null(),
    "boolean": pa.bool_(),
    "int": pa.int32(),
    "long": pa.int64(),
    "float": pa.float32(),
    "double": pa.float64(),
    "bytes": pa.binary(),
    "string": pa.string(),
}
_LOGICAL = {
    "uuid": pa.string(),
    "date": pa.date32(),
    "time-millis": pa.time64("ns"),
    "time-micros": pa.time64("ns"),
    "timestamp-millis": pa.timestamp("us", "UTC"),
    "timestamp-micros": pa.timestamp("us", "UTC"),
    "local-timestamp-millis": pa.timestamp("us"),
    "local-timestamp-micros": pa.timestamp("us"),
    "duration": pa.struct([(n, pa.int32()) for n in ("months", "days", "millis")]),
}


def arrow_type(s: Schema) -> pa.DataType:
    if isinstance(s, Primitive):
        return _PRIMITIVE[s.kind]
    if isinstance(s, Fixed):
        return pa.binary()
    if isinstance(s, Enum):
        return pa.string()
    if isinstance(s, Array):
        return pa.list_(arrow_type(s.items))
    if isinstance(s, Map):
        return pa.map_(pa.string(), arrow_type(s.values))
    if isinstance(s, Record):
        return pa.struct([(f.name, arrow_type(f.type)) for f in s.fields])
    if isinstance(s, Union):
        shape = union_shape(s)
        if shape == "members":
            return pa.struct([(f"member{k}", arrow_type(t)) for k, (_, t) in enumerate(s.members)])
        return {"null": pa.null(), "long": pa.int64(), "double": pa.float64()}.get(shape) or arrow_type(s.members[0][1])
    if s.logical == "decimal":
        return pa.decimal128(s.precision, s.scale) if s.precision <= 38 else pa.binary()
    return _LOGICAL[s.logical]


def to_array(values: list, s: Schema) -> pa.Array:
    """An array of physical values."""
    return pa.array(values, type=arrow_type(s))


def _storage(t: pa.DataType) -> pa.DataType:
    """The type with integers in place of dates and times."""
    if pa.types.is_date32(t):
        return pa.int32()
    if pa.types.is_timestamp(t) or pa.types.is_time(t):
        return pa.int64()
    if pa.types.is_map(t):
        return pa.map_(t.key_type, _storage(t.item_type))
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return pa.list_(_storage(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([(f.name, _storage(f.type)) for f in t])
    return t


def _common(t: pa.DataType) -> pa.DataType:
    """The type with times in nanoseconds and timestamps in microseconds."""
    if pa.types.is_time(t):
        return pa.time64("ns")
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", t.tz)
    if pa.types.is_map(t):
        return pa.map_(t.key_type, _common(t.item_type))
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return pa.list_(_common(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([(f.name, _common(f.type)) for f in t])
    return t


def to_values(column: pa.Array) -> list:
    """Physical values of an array."""
    for kind in (_common(column.type), _storage(_common(column.type))):
        if column.type != kind:
            column = column.cast(kind)
    return column.to_pylist()
