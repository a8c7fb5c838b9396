"""Schemas and Spark types of Python types and values: dataclasses, enums, containers, dates and numbers."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import types
import typing
import uuid
from collections.abc import Callable

from pyspark.sql import types as T

from quillrow import wire
from quillrow.errors import SchemaError
from quillrow.schema import BOOLEAN, BYTES, DOUBLE, LONG, NULL, STRING, Array, Enum, Field, Map, Record, Schema, logical, spark_type, union_of

_SIMPLE = {
    type(None): NULL,
    bool: BOOLEAN,
    int: LONG,
    float: DOUBLE,
    bytes: BYTES,
    bytearray: BYTES,
    str: STRING,
    datetime.datetime: logical("local-timestamp-micros"),
    datetime.date: logical("date"),
    datetime.time: logical("time-micros"),
    uuid.UUID: logical("uuid"),
}


#: Types of the user's that are carried by another: that type, and how its values become the user's.
_LOWERED: dict[type, tuple[object, Callable[[object], object]]] = {}


def lowers(kind: type, to: object, lower: Callable[[object], object], restore: Callable[[object], object]) -> None:
    """Values of a type of the user's are written as another type's: ``lower`` makes these, ``restore`` takes them back."""
    _LOWERED[kind] = to, restore
    wire.LOWERED[kind] = lower


def schema_of(kind: object, name: str | None = None) -> Schema:
    """The schema of a Python type: a user's dataclass becomes a record of its name, a tuple a record of _1, _2, …, a lowered type what carries it."""
    if isinstance(kind, type) and kind in _LOWERED:
        return schema_of(_LOWERED[kind][0], name)
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return union_of(*(schema_of(t) for t in sorted(inner, key=lambda t: t is not type(None))))
    if origin is list:
        return Array(schema_of(inner[0]))
    if origin is dict:
        if inner[0] is not str:
            raise SchemaError("the keys of a map must be strings")
        return Map(schema_of(inner[1]))
    if origin is tuple:
        return Record(name or "Tuple", tuple(Field(f"_{i + 1}", schema_of(t)) for i, t in enumerate(inner)))
    if isinstance(kind, type) and dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        return Record(name or kind.__name__, tuple(Field(f.name, schema_of(hints[f.name])) for f in dataclasses.fields(kind)))
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return Enum(name or kind.__name__, tuple(m.name for m in kind))
    if isinstance(kind, type) and issubclass(kind, tuple) and hasattr(kind, "_fields"):
        hints = typing.get_type_hints(kind)
        return Record(name or kind.__name__, tuple(Field(n, schema_of(hints[n])) for n in kind._fields))
    raise SchemaError(f"{kind!r} has no schema")


def schema_of_value(x: object) -> Schema:
    """The schema of a Python value."""
    if isinstance(x, decimal.Decimal):
        _, digits, exponent = x.as_tuple()
        scale = max(0, -exponent)
        return logical("decimal", precision=max(len(digits) + max(0, exponent), scale, 1), scale=scale)
    if isinstance(x, list):
        return Array(union_of(*(schema_of_value(v) for v in x)) if x else NULL)
    if isinstance(x, dict):
        return Record("Record_" + "_".join(x), tuple(Field(k, schema_of_value(v)) for k, v in x.items()))
    return schema_of(type(x))


def spark_type_of(x: object) -> T.DataType:
    return spark_type(schema_of_value(x))[0]


def host(kind: object, x: object) -> object:
    """The value of a Python type that a physical value, decoded under the type's schema, stands for."""
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if isinstance(kind, type) and kind in _LOWERED:
        to, restore = _LOWERED[kind]
        return restore(host(to, x))
    if x is None or kind in (int, float, str, bool, bytes):
        return x
    if origin in (typing.Union, types.UnionType):
        members = [t for t in inner if t is not type(None)]
        if len(members) == 1:
            return host(members[0], x)
        if isinstance(x, dict) and next(iter(x), "").startswith("member"):
            k, value = next((k, v) for k, v in x.items() if v is not None)
            return host(members[int(k.removeprefix("member"))], value)
        return x
    if origin is list:
        return [host(inner[0], v) for v in x]
    if origin is dict:
        return {k: host(inner[1], v) for k, v in (x.items() if isinstance(x, dict) else x)}
    if origin is tuple:
        return tuple(host(t, x[f"_{k}"]) for k, t in enumerate(inner, 1))
    if kind is datetime.date:
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=x)
    if kind is datetime.datetime:
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=x)
    if kind is datetime.time:
        return (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=x // 1000)).time()
    if kind is uuid.UUID:
        return uuid.UUID(x)
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return kind[x]
    hints = typing.get_type_hints(kind)
    return kind(**{n: host(t, x[n]) for n, t in hints.items() if n in x})


def decode_as(kind: object, data: bytes) -> object:
    """The value of a Python type that the bytes begin with."""
    return host(kind, wire.decode(schema_of(kind), data))
