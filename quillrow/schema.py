"""Schemas of the row format: an immutable tree, its JSON form, and its mapping to Spark types.

A primitive is ``Primitive``; named types are ``Record``, ``Enum`` and ``Fixed``; ``Logical`` wraps
the type that carries it. Equality is structural and ignores documentation, aliases, defaults and
namespaces, as the format's readers do.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from quillrow.errors import SchemaError

# Names of the format.
PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
LOGICAL_BASES = {
    "decimal": ("bytes", "fixed"),
    "uuid": ("string",),
    "date": ("int",),
    "time-millis": ("int",),
    "time-micros": ("long",),
    "timestamp-millis": ("long",),
    "timestamp-micros": ("long",),
    "local-timestamp-millis": ("long",),
    "local-timestamp-micros": ("long",),
    "duration": ("fixed",),
}
ORDERS = ("ascending", "descending", "ignore")
NAME = re.compile("[A-Za-z_][A-Za-z0-9_]*")
#: Key of a field's metadata that holds its schema as JSON, for what Spark types cannot express.
METADATA = "row_schema"


def full_name(name: str, namespace: str | None) -> str:
    return f"{namespace}.{name}" if namespace and "." not in name else name


@dataclass(frozen=True)
class Primitive:
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in PRIMITIVES:
            raise SchemaError(f"unknown type {self.kind!r}")


@dataclass(frozen=True)
class Array:
    items: Schema
    kind: str = "array"


@dataclass(frozen=True)
class Map:
    values: Schema
    kind: str = "map"


@dataclass(frozen=True)
class Field:
    name: str
    type: Schema
    doc: str | None = field(default=None, compare=False)
    default: object = field(default=None, compare=False)
    has_default: bool = field(default=False, compare=False)
    order: str = field(default="ascending", compare=False)
    aliases: tuple[str, ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class Record:
    name: str
    fields: tuple[Field, ...]
    namespace: str | None = field(default=None, compare=False)
    doc: str | None = field(default=None, compare=False)
    aliases: tuple[str, ...] = field(default=(), compare=False)
    kind: str = "record"

    def __post_init__(self) -> None:
        if len({f.name for f in self.fields}) != len(self.fields):
            raise SchemaError(f"record {self.name} repeats a field name")

    @property
    def full_name(self) -> str:
        return full_name(self.name, self.namespace)

    def project(self, names: list[str]) -> Record:
        """The record with these fields only, in the given order."""
        by = {f.name: f for f in self.fields}
        return Record(self.name, tuple(by[n] for n in names), self.namespace, self.doc, self.aliases)


@dataclass(frozen=True)
class Enum:
    name: str
    symbols: tuple[str, ...]
    namespace: str | None = field(default=None, compare=False)
    doc: str | None = field(default=None, compare=False)
    aliases: tuple[str, ...] = field(default=(), compare=False)
    default: str | None = field(default=None, compare=False)
    kind: str = "enum"

    def __post_init__(self) -> None:
        for s in self.symbols:
            if not NAME.fullmatch(s):
                raise SchemaError(f"{s!r} is no enum symbol")
        if len(set(self.symbols)) != len(self.symbols):
            raise SchemaError(f"enum {self.name} repeats a symbol")

    @property
    def full_name(self) -> str:
        return full_name(self.name, self.namespace)

    def shown(self) -> list[str]:
        return [f"{s} = {i}" for i, s in enumerate(self.symbols)]


@dataclass(frozen=True)
class Fixed:
    name: str
    size: int
    namespace: str | None = field(default=None, compare=False)
    aliases: tuple[str, ...] = field(default=(), compare=False)
    kind: str = "fixed"

    def __post_init__(self) -> None:
        if self.size < 0:
            raise SchemaError(f"fixed {self.name} has a negative size")

    @property
    def full_name(self) -> str:
        return full_name(self.name, self.namespace)


@dataclass(frozen=True)
class Union:
    types: tuple[Schema, ...]
    kind: str = "union"

    def __post_init__(self) -> None:
        if any(isinstance(t, Union) for t in self.types):
            raise SchemaError("a union may not hold a union")

    @property
    def null_branch(self) -> int | None:
        return next((i for i, t in enumerate(self.types) if t == Primitive("null")), None)

    @property
    def members(self) -> list[tuple[int, Schema]]:
        return [(i, t) for i, t in enumerate(self.types) if t != Primitive("null")]


@dataclass(frozen=True)
class Logical:
    """A logical type over the type that carries it. little: a decimal in the low byte first, as files with an unnamed fixed have it."""

    logical: str
    base: Schema
    precision: int = 0
    scale: int = 0
    little: bool = field(default=False, compare=False)
    kind: str = "logical"


Schema = Primitive | Array | Map | Record | Enum | Fixed | Union | Logical

NULL, BOOLEAN, INT, LONG, FLOAT, DOUBLE, BYTES, STRING = map(Primitive, PRIMITIVES)


def union_of(*types: Schema) -> Schema:
    """A union, nested unions spread out and repeats dropped; a single type stays itself."""
    flat: list[Schema] = []
    for t in types:
        flat += [x for x in (t.types if isinstance(t, Union) else (t,)) if x not in flat]
    return flat[0] if len(flat) == 1 else Union(tuple(flat))


def nullable(t: Schema) -> Schema:
    return t if t == NULL or (isinstance(t, Union) and t.null_branch is not None) else union_of(NULL, t)


def decimal_size(precision: int) -> int:
    """Bytes that hold every unscaled value of a precision."""
    return next(n for n in range(1, 65) if 10**precision - 1 <= 2 ** (8 * n - 1) - 1)


def logical(name: str, *, precision: int = 0, scale: int = 0, size: int = 16) -> Logical:
    """A logical type over its usual carrier."""
    if name == "decimal":
        if not 0 < precision or not 0 <= scale <= precision or size < decimal_size(precision):
            raise SchemaError(f"decimal({precision},{scale}) does not fit {size} bytes")
        return Logical(name, Fixed(f"decimal_{precision}_{scale}", size), precision, scale)
    if name == "duration":
        return Logical(name, Fixed("duration", 12))
    if name not in LOGICAL_BASES:
        raise SchemaError(f"unknown logical type {name!r}")
    return Logical(name, Primitive(LOGICAL_BASES[name][0]))


# -- JSON ---------------------------------------------------------------------------------------


class _Parser:
    def __init__(self) -> None:
        self.names: dict[str, Schema | None] = {}

    def named(self, node: dict, namespace: str | None, unnamed: str) -> tuple[str, str | None]:
        name = node.get("name") or unnamed
        if "." in name:
            namespace, name = name.rsplit(".", 1)
        else:
            namespace = node.get("namespace", namespace)
        self.names[full_name(name, namespace)] = None  # open: a use before the end is recursion
        return name, namespace

    def done(self, schema: Record | Enum | Fixed) -> Schema:
        self.names[schema.full_name] = schema
        return schema

    def parse(self, node: object, namespace: str | None = None) -> Schema:
        if isinstance(node, str):
            if node in PRIMITIVES:
                return Primitive(node)
            for name in dict.fromkeys((full_name(node, namespace), node)):
                if name in self.names:
                    if self.names[name] is None:
                        raise SchemaError(f"{node} holds itself; Spark has no recursive types")
                    return self.names[name]
            raise SchemaError(f"unknown type {node!r}")
        if isinstance(node, list):
            return Union(tuple(self.parse(x, namespace) for x in node))
        if not isinstance(node, dict) or "type" not in node:
            raise SchemaError(f"no schema: {node!r}")
        kind = node["type"]
        try:
            base = self.complex(kind, node, namespace)
        except KeyError as missing:
            raise SchemaError(f"{kind} lacks {missing}") from None
        return self.logical(node, base)

    def complex(self, kind: object, node: dict, namespace: str | None) -> Schema:
        if kind == "array":
            return Array(self.parse(node["items"], namespace))
        if kind == "map":
            return Map(self.parse(node["values"], namespace))
        if kind in ("record", "error"):
            name, space = self.named(node, namespace, "Record_")
            fields = []
            for f in node["fields"]:
                order = f.get("order", "ascending")
                if order not in ORDERS:
                    raise SchemaError(f"{order!r} is no order")
                fields.append(Field(f["name"], self.parse(f["type"], space), f.get("doc"), f.get("default"), "default" in f, order, tuple(f.get("aliases") or ())))
            return self.done(Record(name, tuple(fields), space, node.get("doc"), tuple(node.get("aliases") or ())))
        if kind == "enum":
            name, space = self.named(node, namespace, "Enum_" + "_".join(node["symbols"]))
            return self.done(Enum(name, tuple(node["symbols"]), space, node.get("doc"), tuple(node.get("aliases") or ()), node.get("default")))
        if kind == "fixed":
            name, space = self.named(node, namespace, f"Fixed_{node['size']}")
            return self.done(Fixed(name, node["size"], space, tuple(node.get("aliases") or ())))
        return self.parse(kind, namespace)

    @staticmethod
    def logical(node: dict, base: Schema) -> Schema:
        name = node.get("logicalType")
        if name not in LOGICAL_BASES or getattr(base, "kind", None) not in LOGICAL_BASES[name]:
            return base  # unknown or misplaced logical types are ignored
        if name == "duration" and base.size != 12:
            return base
        if name == "decimal":
            precision, scale = node.get("precision", 0), node.get("scale", 0)
            if not isinstance(precision, int) or precision < 1 or not 0 <= scale <= precision:
                return base
            return Logical(name, base, precision, scale, little=isinstance(base, Fixed) and not node.get("name"))
        return Logical(name, base)


def parse(text: str) -> Schema:
    """A schema from its JSON text. A bare type name need not be quoted."""
    text = text.strip()
    if text in PRIMITIVES:
        return Primitive(text)
    try:
        node = json.loads(text)
    except ValueError as error:
        raise SchemaError(f"the schema is no JSON: {error}") from None
    return _Parser().parse(node)


def parse_file(file_or_json: str) -> Schema:
    """Like parse, but a path to a file that exists is read first."""
    import os

    if os.path.isfile(file_or_json):
        with open(file_or_json, encoding="utf-8") as file:
            file_or_json = file.read()
    return parse(file_or_json)


def to_json(schema: Schema) -> object:
    """The JSON tree; a named type that was written before is named only."""
    return _rendered(schema, {})


def _rendered(s: Schema, seen: dict[str, Schema]) -> object:
    if isinstance(s, Primitive):
        return s.kind
    if isinstance(s, Union):
        return [_rendered(t, seen) for t in s.types]
    if isinstance(s, Array):
        return {"type": "array", "items": _rendered(s.items, seen)}
    if isinstance(s, Map):
        return {"type": "map", "values": _rendered(s.values, seen)}
    if isinstance(s, Logical):
        base = _rendered(s.base, seen)
        if isinstance(base, str) and base not in PRIMITIVES:  # a carrier that was written before
            base = _rendered(s.base, {})
        out = dict(base) if isinstance(base, dict) else {"type": base}
        out["logicalType"] = s.logical
        if s.logical == "decimal":
            out |= {"precision": s.precision, "scale": s.scale}
        if s.little:
            out.pop("name", None)
        return out
    if seen.get(s.full_name) == s:
        return s.full_name
    seen[s.full_name] = s
    out: dict[str, object] = {"type": s.kind, "name": s.name}
    if s.namespace:
        out["namespace"] = s.namespace
    if getattr(s, "doc", None):
        out["doc"] = s.doc
    if s.aliases:
        out["aliases"] = list(s.aliases)
    if isinstance(s, Enum):
        out["symbols"] = list(s.symbols)
        if s.default is not None:
            out["default"] = s.default
    elif isinstance(s, Fixed):
        out["size"] = s.size
    else:
        out["fields"] = [_field(f, seen) for f in s.fields]
    return out


def _field(f: Field, seen: dict[str, Schema]) -> dict:
    out: dict[str, object] = {"name": f.name, "type": _rendered(f.type, seen)}
    if f.doc:
        out["doc"] = f.doc
    if f.has_default:
        out["default"] = f.default
    if f.order != "ascending":
        out["order"] = f.order
    if f.aliases:
        out["aliases"] = list(f.aliases)
    return out


def render(schema: Schema) -> str:
    return json.dumps(to_json(schema), separators=(",", ":"), ensure_ascii=False)


# -- Spark types --------------------------------------------------------------------------------

_SPARK = {
    "null": T.NullType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
}
DURATION = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("months", "days", "millis")])


def spark_type(s: Schema) -> tuple[T.DataType, bool]:
    """(type, whether null is a value)."""
    if isinstance(s, Primitive):
        return _SPARK[s.kind], s.kind == "null"
    if isinstance(s, Fixed):
        return T.BinaryType(), False
    if isinstance(s, Enum):
        return T.StringType(), False
    if isinstance(s, Array):
        item, null = spark_type(s.items)
        return T.ArrayType(item, null), False
    if isinstance(s, Map):
        value, null = spark_type(s.values)
        return T.MapType(T.StringType(), value, null), False
    if isinstance(s, Record):
        return to_spark(s), False
    if isinstance(s, Union):
        return _union_type(s)
    return _logical_type(s), False


def _logical_type(s: Logical) -> T.DataType:
    if s.logical == "decimal":
        return T.DecimalType(s.precision, s.scale) if s.precision <= 38 else T.BinaryType()
    return {
        "uuid": T.StringType(),
        "date": T.DateType(),
        "time-millis": T.TimeType(3),
        "time-micros": T.TimeType(6),
        "timestamp-millis": T.TimestampType(),
        "timestamp-micros": T.TimestampType(),
        "local-timestamp-millis": T.TimestampNTZType(),
        "local-timestamp-micros": T.TimestampNTZType(),
        "duration": DURATION,
    }[s.logical]


def union_shape(s: Union) -> str:
    """How a union is seen in Spark: null, one (a nullable member), long, double, or members (a struct)."""
    kinds = [getattr(t, "kind", None) for _, t in s.members]
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return "one"
    if set(kinds) == {"int", "long"}:
        return "long"
    if set(kinds) == {"float", "double"}:
        return "double"
    return "members"


def _union_type(s: Union) -> tuple[T.DataType, bool]:
    null, shape = s.null_branch is not None, union_shape(s)
    if shape == "null":
        return T.NullType(), True
    if shape == "one":
        return spark_type(s.members[0][1])[0], null
    if shape in ("long", "double"):
        return _SPARK[shape], null
    return T.StructType([T.StructField(f"member{k}", spark_type(t)[0], True) for k, (_, t) in enumerate(s.members)]), null


def to_spark(s: Record) -> T.StructType:
    """The struct of a record; each field's metadata keeps its schema."""
    return T.StructType([T.StructField(f.name, *spark_type(f.type), {METADATA: render(f.type)}) for f in s.fields])


def from_spark(kind: T.DataType, name: str = "row", null: bool = False, metadata: dict | None = None) -> Schema:
    """The schema of a Spark type. Metadata written by ``to_spark`` wins where it still fits the type."""
    if metadata and METADATA in metadata:
        kept = parse(metadata[METADATA])
        if spark_type(kept)[0].simpleString() == kind.simpleString():
            return nullable(kept) if null else kept
    found = _derived(kind, name)
    return nullable(found) if null else found


def _derived(kind: T.DataType, name: str) -> Schema:
    if isinstance(kind, T.StructType):
        if kind.simpleString() == DURATION.simpleString() and name.endswith("duration"):
            return logical("duration")
        return Record(_safe(name), tuple(Field(_safe(f.name), from_spark(f.dataType, f"{name}_{f.name}", f.nullable, f.metadata)) for f in kind))
    if isinstance(kind, T.ArrayType):
        return Array(from_spark(kind.elementType, f"{name}_item", kind.containsNull))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise SchemaError("the keys of a map must be strings")
        return Map(from_spark(kind.valueType, f"{name}_value", kind.valueContainsNull))
    if isinstance(kind, T.DecimalType):
        return logical("decimal", precision=kind.precision, scale=kind.scale)
    if isinstance(kind, T.TimeType):
        return logical("time-millis" if kind.precision <= 3 else "time-micros")
    for spark, found in (
        (T.NullType, NULL),
        (T.BooleanType, BOOLEAN),
        ((T.ByteType, T.ShortType, T.IntegerType), INT),
        (T.LongType, LONG),
        (T.FloatType, FLOAT),
        (T.DoubleType, DOUBLE),
        (T.BinaryType, BYTES),
        (T.StringType, STRING),
        (T.DateType, logical("date")),
        (T.TimestampNTZType, logical("local-timestamp-micros")),
        (T.TimestampType, logical("timestamp-micros")),
    ):
        if isinstance(kind, spark):
            return found
    raise SchemaError(f"{kind.simpleString()} has no schema")


def _safe(name: str) -> str:
    """A name that the format allows."""
    return name if NAME.fullmatch(name) else re.sub("[^A-Za-z0-9_]", "_", name if name[:1].isalpha() or name[:1] == "_" else "_" + name)
