"""Single values as columns: ``to_binary``, ``from_binary``, ``encoded_size``.

Where built-in functions can express an encoding it stays in the JVM; otherwise Arrow batches go
through the generated codec.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrow import wire
from quillrow.arrow import to_array, to_values
from quillrow.runtime import ship
from quillrow.schema import Enum, Fixed, Logical, Primitive, Record, Schema, Union, parse, spark_type, union_shape


def _schema(schema: Schema | str) -> Schema:
    return parse(schema) if isinstance(schema, str) else schema


def zigzag(x: Column) -> Column:
    """Small numbers of either sign as small unsigned ones."""
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))


def varint_size(z: Column) -> Column:
    """Bytes of the varint of an unsigned number."""
    out = F.lit(1)
    for k in range(1, 10):
        out = out + (F.shiftrightunsigned(z, 7 * k) != 0).cast("int")
    return out


def varint(z: Column) -> Column:
    """The varint of an unsigned number, as bytes."""
    rest = lambda k: F.shiftrightunsigned(z, 7 * k) if k else z
    more = lambda k: F.when(rest(k) != 0, F.lit(128)).otherwise(F.lit(0)).cast("long") if k < 10 else F.lit(0).cast("long")
    byte = lambda k: F.lpad(F.hex(rest(k).bitwiseAND(F.lit(127).cast("long")).bitwiseOR(more(k + 1))), 2, "0")
    return F.unhex(F.concat(byte(0), *(F.when(rest(k) != 0, byte(k)).when(z.isNotNull(), F.lit("")) for k in range(1, 10))))


def _raise(what: str | Column) -> Column:
    return F.raise_error(F.lit(what) if isinstance(what, str) else what)


def _long_of(s: Logical, x: Column) -> Column | None:
    """The integer that carries a logical value."""
    of_day = lambda: F.time_diff(F.lit("microsecond"), F.make_time(F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")), x)
    return {
        "time-micros": of_day,
        "time-millis": lambda: F.floor(of_day() / 1000).cast("long"),
        "date": lambda: F.unix_date(x).cast("long"),
        "timestamp-micros": lambda: F.unix_micros(x),
        "timestamp-millis": lambda: F.unix_millis(x),
        "local-timestamp-micros": lambda: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), x),
        "local-timestamp-millis": lambda: F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), x) / 1000).cast("long"),
    }.get(s.logical, lambda: None)()


def native_encoding(s: Schema, x: Column) -> Column | None:
    """The encoding by built-in functions, or None if they cannot express it. Null where x is null and the schema has no null."""
    if isinstance(s, Primitive):
        if s.kind == "null":
            return F.lit(b"")
        if s.kind == "boolean":
            return F.when(x, F.lit(b"\x01")).when(~x, F.lit(b"\x00"))
        if s.kind == "int":
            return F.when(x.cast("long").between(-(2**31), 2**31 - 1), varint(zigzag(x))).when(x.isNotNull(), _raise(F.concat(x.cast("string"), F.lit(" is no int"))))
        if s.kind == "long":
            return varint(zigzag(x))
        if s.kind == "bytes":
            return F.concat(varint(zigzag(F.octet_length(x))), x)
        if s.kind == "string":
            return F.concat(varint(zigzag(F.octet_length(x.cast("string")))), F.encode(x.cast("string"), "UTF-8"))
        return None
    if isinstance(s, Fixed):
        return F.when(F.octet_length(x) == s.size, x).when(x.isNotNull(), _raise(f"fixed {s.name} takes {s.size} bytes"))
    if isinstance(s, Enum):
        at = F.array_position(F.array(*map(F.lit, s.symbols)), x)
        return F.when(at > 0, varint(zigzag(at - 1))).when(x.isNotNull(), _raise(F.concat(F.lit(f"enum {s.name} has no symbol "), x)))
    if isinstance(s, Record):
        parts = [native_encoding(f.type, x[f.name]) for f in s.fields]
        if any(p is None for p in parts):
            return None
        present = [F.coalesce(p, _raise(f"null under a schema without null: field {f.name}")) for f, p in zip(s.fields, parts, strict=True)]
        return F.when(x.isNotNull(), F.concat(*present)) if parts else F.lit(b"")
    if isinstance(s, Union):
        if union_shape(s) not in ("one", "null"):
            return None
        null = None if s.null_branch is None else F.lit(wire.varint(2 * s.null_branch))
        if union_shape(s) == "null":
            return null
        branch, member = s.members[0]
        inner = native_encoding(member, x)
        if inner is None:
            return None
        whole = F.concat(F.lit(wire.varint(2 * branch)), inner)
        return whole if null is None else F.when(x.isNull(), null).otherwise(whole)
    if isinstance(s, Logical):
        if s.logical == "uuid":
            y = F.lower(x)  # its length is known, so that its varint does not compute it again and again
            return F.when(y.rlike(rf"^(?:{wire.UUID.pattern})\z"), F.concat(F.lit(wire.varint(2 * 36)), F.encode(y, "UTF-8"))).when(x.isNotNull(), _raise("no uuid"))
        carried = _long_of(s, x)
        return None if carried is None else varint(zigzag(carried))
    return None


def _as_arrow(kind: T.DataType) -> T.DataType:
    """The type as Arrow batches bring it: every TIME has six digits there."""
    if isinstance(kind, T.TimeType):
        return T.TimeType(6)
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_arrow(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _as_arrow(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_arrow(f.dataType), f.nullable) for f in kind])
    return kind


def arrow_encoding(s: Schema, x: Column) -> Column:
    ship()

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = wire.encoder(s)  # compiled once for each task
        has_null = s == Primitive("null") or (isinstance(s, Union) and s.null_branch is not None)
        for values in batches:
            yield pa.array([run(v) if v is not None or has_null else None for v in to_values(values)], pa.binary())

    return encode(x)


def to_binary(x: Column, schema: Schema | str, native: bool | None = None) -> Column:
    """The encoded value. native forces (True) or forbids (False) built-in functions."""
    s = _schema(schema)
    found = None if native is False else native_encoding(s, x)
    if found is None and native:
        raise ValueError("built-in functions cannot express this schema")
    return arrow_encoding(s, x) if found is None else found


# -- decoding by built-in functions --------------------------------------------------------------
#
# A reader takes the bytes and a place in them (from 1) and gives a struct of the value, v, and the place behind it, p.
# What a step needs more than once is computed once, by a lambda function: written out, expressions would outgrow generated code.

Reader = Callable[[Column, Column], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _read(value: Column, behind: Column) -> Column:
    return F.struct(value.alias("v"), behind.cast("int").alias("p"))


def _byte(digits: Column, at: Column) -> Column:
    """The byte of hex digits at a place from 0."""
    return F.conv(digits.substr(at * 2 + 1, F.lit(2)), 16, 10).cast("long")


def _read_varint(data: Column, at: Column) -> Column:
    def longer(digits: Column) -> Column:
        n = (F.length(digits) / 2).cast("int")
        low = lambda i: _byte(digits, i).bitwiseAND(F.lit(127).cast("long"))
        value = F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda z, i: F.shiftleft(z, 7).bitwiseOR(low(i)))
        return F.when(n == 0, _raise("unexpected end of data, or a number of more than ten bytes")).when((n == 10) & (low(F.lit(9)) > 1), _raise("a number of more than 64 bits")).otherwise(_read(value, at + n))

    def first(digits: Column) -> Column:
        whole = F.regexp_extract(digits, "^((?:[89A-F][0-9A-F]){0,9}[0-7][0-9A-F])", 1)
        return F.when(digits.rlike("^[0-7]"), _read(_byte(digits, F.lit(0)), at + 1)).otherwise(_let(whole, longer))

    return _let(F.hex(data.substr(at, F.lit(10))), first)


def _read_long(data: Column, at: Column) -> Column:
    return _let(_read_varint(data, at), lambda r: _read(unzigzag(r["v"]), r["p"]))


def _read_span(data: Column, at: Column, size: Column) -> Column:
    ends = (size >= 0) & (size <= F.octet_length(data) - at + 1)
    return F.when(ends, _read(data.substr(at.cast("int"), size.cast("int")), at + size)).otherwise(_raise("unexpected end of data"))


def native_reader(s: Schema) -> Reader | None:
    """A reader made of built-in functions, or None if they cannot express the decoding. Columns are made when it is called, so no session is needed here."""
    then = lambda read, value: lambda data, at: _let(read(data, at), lambda r: _read(value(r["v"]), r["p"]))
    if isinstance(s, Primitive):
        if s.kind == "null":
            return lambda data, at: _read(F.lit(None), at)
        if s.kind == "boolean":
            truth = lambda v: F.when(v == b"\x01", F.lit(True)).when(v == b"\x00", F.lit(False)).otherwise(_raise("no boolean"))
            return then(lambda data, at: _read_span(data, at, F.lit(1)), truth)
        if s.kind == "int":
            return then(_read_long, lambda v: F.when(v.between(-(2**31), 2**31 - 1), v.cast("int")).otherwise(_raise(F.concat(v.cast("string"), F.lit(" is no int")))))
        if s.kind == "long":
            return _read_long
        if s.kind in ("bytes", "string"):
            span = lambda data, at: _let(_read_long(data, at), lambda r: _read_span(data, r["p"], r["v"]))
            return span if s.kind == "bytes" else then(span, lambda v: F.validate_utf8(v.cast("string")))
        return None
    if isinstance(s, Fixed):
        return lambda data, at: _read_span(data, at, F.lit(s.size))
    if isinstance(s, Enum):
        symbols = lambda: F.array(*map(F.lit, s.symbols))
        return then(_read_long, lambda v: F.when(v.between(0, len(s.symbols) - 1), F.get(symbols(), v.cast("int"))).otherwise(_raise(F.concat(F.lit(f"enum {s.name} has no symbol "), v.cast("string")))))
    if isinstance(s, Record):
        readers = [native_reader(f.type) for f in s.fields]
        return None if None in readers or not readers else lambda data, at: _read_fields(s, readers, data, at, [])
    if isinstance(s, Union):
        if union_shape(s) not in ("one", "null"):
            return None
        readers = {i: native_reader(t) for i, t in enumerate(s.types)}
        if None in readers.values() or not s.members:
            return None
        nothing = lambda at: _read(F.lit(None).cast(spark_type(s)[0]), at)

        def branch(data: Column, r: Column) -> Column:
            out = _raise(F.concat(F.lit("the union has no branch "), r["v"].cast("string")))
            for i, read in readers.items():
                out = F.when(r["v"] == i, nothing(r["p"]) if i == s.null_branch else read(data, r["p"])).otherwise(out)
            return out

        return lambda data, at: _let(_read_long(data, at), lambda r: branch(data, r))
    if isinstance(s, Logical):
        epoch = lambda: F.lit("1970-01-01").cast("timestamp_ntz")
        shown = {
            "date": F.date_from_unix_date,
            "timestamp-micros": F.timestamp_micros,
            "timestamp-millis": F.timestamp_millis,
            "local-timestamp-micros": lambda v: F.timestamp_add("MICROSECOND", v, epoch()),
            "local-timestamp-millis": lambda v: F.timestamp_add("MICROSECOND", v * 1000, epoch()),
            "uuid": lambda v: v,
        }.get(s.logical)
        read = native_reader(s.base)
        return None if shown is None or read is None else then(read, shown)
    return None


def _read_fields(s: Record, readers: list[Reader], data: Column, at: Column, done: list[Column]) -> Column:
    """The fields one behind the other: each reader begins where the one before ended."""
    if len(done) == len(readers):
        return _read(F.struct(*(v.alias(f.name) for v, f in zip(done, s.fields, strict=True))), at)
    return _let(readers[len(done)](data, at), lambda r: _read_fields(s, readers, data, r["p"], [*done, r["v"]]))


def native_decoding(s: Schema, data: Column) -> Column | None:
    """The value by built-in functions, or None if they cannot express it."""
    read = native_reader(s)
    # Readers name the bytes in every step; data may be a whole encoding.
    return None if read is None else _let(data, lambda whole: F.when(whole.isNotNull(), read(whole, F.lit(1))["v"]))


def arrow_decoding(s: Schema, data: Column, permissive: bool) -> Column:
    ship()
    kind = spark_type(s)[0]

    @F.arrow_udf(_as_arrow(kind))
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = wire.decoder(s)  # compiled once for each task
        for values in batches:
            out = []
            for b in values.to_pylist():
                try:
                    out.append(None if b is None else run(b, 0, len(b))[0])
                except ValueError:
                    if not permissive:
                        raise
                    out.append(None)
            yield to_array(out, s)

    return decode(data) if _as_arrow(kind) == kind else decode(data).cast(kind)


def from_binary(data: Column, schema: Schema | str, permissive: bool = False, native: bool = False) -> Column:
    """The value that the bytes begin with; null for null. Damaged bytes raise, or give null if permissive.

    native decodes by built-in functions, without Python workers, where they can express the schema. They
    raise for the same bytes but cannot be permissive, and take about twice the time of Arrow batches through
    """
    s = _schema(schema)
    if not native:
        return arrow_decoding(s, data, permissive)
    found = None if permissive else native_decoding(s, data)
    if found is None:
        raise ValueError("built-in functions cannot express this decoding")
    return found


def encoded_size(x: Column, schema: Schema | str) -> Column:
    """Bytes of the encoded value."""
    s = _schema(schema)
    if isinstance(s, Primitive) and s.kind in ("int", "long"):
        return varint_size(zigzag(x))
    if isinstance(s, Primitive) and s.kind in ("bytes", "string"):
        n = F.octet_length(x)
        return varint_size(zigzag(n)) + n
    carried = _long_of(s, x) if isinstance(s, Logical) else None
    if carried is not None:
        return varint_size(zigzag(carried))
    found = native_encoding(s, x)
    if found is not None:
        return F.octet_length(found)
    ship()

    @F.arrow_udf("int")
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if v is None and not isinstance(s, Union) else wire.encoded_size(s, v) for v in to_values(values)], pa.int32())

    return size(x)


def duration_interval(x: Column) -> Column:
    """A decoded duration as an interval."""
    return F.make_interval(F.lit(0), x["months"], F.lit(0), x["days"], F.lit(0), F.lit(0), (x["millis"] / 1000).cast("decimal(18,6)"))
