"""Binary encoding: for each schema, flat Python functions are generated once and compiled.

Values are physical, as Arrow takes them: a date is days, a time nanoseconds of the day, a
timestamp microseconds, a map a list of pairs, a record a dict, a decimal a ``Decimal``, a
duration a dict, an enum its symbol, and a union of several members a dict of member0, member1, …
with one of them set. ``host_value`` brings Python's own date and time objects to this form.
"""

from __future__ import annotations

import datetime
import decimal
import enum
import re
import struct
import uuid
from collections.abc import Callable

from quillrow.errors import DecodeError, EncodeError
from quillrow.schema import Array, Enum, Fixed, Logical, Map, Primitive, Record, Schema, Union, union_shape

UUID = re.compile("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_LONG = 1 << 63
#: Encoders of logical types that sizes were asked of.
_ENCODERS: dict[Logical, Callable[[object], bytes]] = {}


def zigzag(x: int) -> int:
    return (x << 1) ^ (x >> 63)


def unzigzag(z: int) -> int:
    return (z >> 1) ^ -(z & 1)


def varint(z: int) -> bytes:
    """Seven bits a byte, low ones first."""
    out = bytearray()
    while z > 127:
        out.append(z & 127 | 128)
        z >>= 7
    out.append(z)
    return bytes(out)


#: The encodings of small numbers, by their zigzag form.
_SMALL = [varint(z) for z in range(1 << 14)]


def _number(buf: bytes, pos: int, end: int) -> tuple[int, int]:
    """A varint of at most ten bytes, not yet unzigzagged."""
    z = shift = 0
    while True:
        if pos >= end:
            raise DecodeError("unexpected end of data")
        b = buf[pos]
        pos += 1
        z |= (b & 127) << shift
        if b < 128:
            if z >> 64:
                raise DecodeError("a number of more than 64 bits")
            return z, pos
        shift += 7
        if shift > 63:
            raise DecodeError("a number of more than ten bytes")


def _bad(what: str, error: type = DecodeError):
    raise error(what)


def _too_long(kind: str, x: int):
    raise EncodeError(f"{x} is no {kind}")


class _Source:
    """Lines of a function under construction, and the objects that it uses."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.known: dict[str, object] = {
            "number": _number,
            "bad": _bad,
            "too_long": _too_long,
            "small": _SMALL,
            "varint": varint,
            "f4": struct.Struct("<f"),
            "f8": struct.Struct("<d"),
            "i3": struct.Struct("<III"),
            "Decimal": decimal.Decimal,
            "EncodeError": EncodeError,
            "uuid_form": UUID.fullmatch,
            "as_int": int.from_bytes,
        }
        self.n = 0

    def name(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def keep(self, value: object) -> str:
        name = f"k{len(self.known)}"
        self.known[name] = value
        return name

    def add(self, depth: int, *lines: str) -> None:
        self.lines += ["    " * depth + x for x in lines]

    def function(self, head: str) -> Callable:
        space = dict(self.known)
        exec(compile("\n".join([head, *self.lines]), "<row codec>", "exec"), space)
        return space["run"]


# -- decode and skip ----------------------------------------------------------------------------


def _read_number(src: _Source, depth: int, out: str, signed: bool = True) -> None:
    """A varint; reading beyond the bytes is an IndexError, which ``_guarded`` turns into a DecodeError."""
    src.add(depth, f"{out} = buf[pos]; pos += 1", f"if {out} > 127: {out}, pos = number(buf, pos - 1, end)")
    if signed:
        src.add(depth, f"{out} = ({out} >> 1) ^ -({out} & 1)")


def _guarded(run: Callable) -> Callable:
    """A reader that raises where it went beyond the end."""

    def read(buf: bytes, pos: int, end: int, *rows: int) -> object:
        try:
            found = run(buf, pos, end, *rows)
        except IndexError:
            raise DecodeError("unexpected end of data") from None
        if (found[1] if isinstance(found, tuple) else found) > end:
            raise DecodeError("unexpected end of data")
        return found

    return read


def _read_span(src: _Source, depth: int, size: str) -> str:
    """Moves pos over size bytes; the start is returned."""
    start = src.name()
    src.add(depth, f"{start} = pos; pos += {size}", f"if pos > end or {size} < 0: bad('unexpected end of data')")
    return start


def _gen_read(src: _Source, s: Schema, depth: int, out: str) -> None:
    if isinstance(s, Primitive):
        _gen_read_primitive(src, s.kind, depth, out)
    elif isinstance(s, Fixed):
        start = _read_span(src, depth, str(s.size))
        src.add(depth, f"{out} = buf[{start}:pos]")
    elif isinstance(s, Enum):
        _read_number(src, depth, out)
        src.add(depth, f"if not 0 <= {out} < {len(s.symbols)}: bad(f'enum {s.name} has no symbol {{{out}}}')", f"{out} = {src.keep(s.symbols)}[{out}]")
    elif isinstance(s, Array | Map):
        _gen_blocks(src, s, depth, out)
    elif isinstance(s, Record):
        parts = []
        for f in s.fields:
            parts.append((f.name, v := src.name()))
            _gen_read(src, f.type, depth, v)
        src.add(depth, f"{out} = {{{', '.join(f'{n!r}: {v}' for n, v in parts)}}}")
    elif isinstance(s, Union):
        _gen_read_union(src, s, depth, out)
    else:
        _gen_read_logical(src, s, depth, out)


def _gen_read_primitive(src: _Source, kind: str, depth: int, out: str) -> None:
    if kind == "null":
        src.add(depth, f"{out} = None")
    elif kind == "boolean":
        start = _read_span(src, depth, "1")
        src.add(depth, f"{out} = buf[{start}]", f"if {out} > 1: bad(f'{{{out}}} is no boolean')", f"{out} = {out} == 1")
    elif kind in ("int", "long"):
        _read_number(src, depth, out)
        if kind == "int":
            src.add(depth, f"if not -2147483648 <= {out} <= 2147483647: bad(f'{{{out}}} is no int')")
    elif kind in ("float", "double"):
        width = 4 if kind == "float" else 8
        start = _read_span(src, depth, str(width))
        src.add(depth, f"{out}, = f{width}.unpack_from(buf, {start})")
    else:
        size = src.name()
        _read_number(src, depth, size)
        start = _read_span(src, depth, size)
        src.add(depth, f"{out} = buf[{start}:pos]" + (".decode()" if kind == "string" else ""))


def _gen_blocks(src: _Source, s: Array | Map, depth: int, out: str) -> None:
    n, size, item = src.name(), src.name(), src.name()
    until = src.name()
    src.add(depth, f"{out} = {{}}" if isinstance(s, Map) else f"{out} = []", "while True:")
    _read_number(src, depth + 1, n)
    src.add(depth + 1, f"if {n} == 0: break", f"{until} = -1", f"if {n} < 0:")
    _read_number(src, depth + 2, size)
    src.add(depth + 2, f"{n} = -{n}; {until} = pos + {size}", f"if {size} < 0 or {until} > end: bad('unexpected end of data')")
    src.add(depth + 1, f"for _ in range({n}):")
    if isinstance(s, Map):
        key = src.name()
        _gen_read_primitive(src, "string", depth + 2, key)
        _gen_read(src, s.values, depth + 2, item)
        src.add(depth + 2, f"{out}[{key}] = {item}")  # of equal keys the last stays
    else:
        _gen_read(src, s.items, depth + 2, item)
        src.add(depth + 2, f"{out}.append({item})")
    src.add(depth + 1, f"if {until} >= 0 and {until} != pos: bad('a block does not have its size')")
    if isinstance(s, Map):
        src.add(depth, f"{out} = list({out}.items())")


def _gen_read_union(src: _Source, s: Union, depth: int, out: str) -> None:
    branch, shape = src.name(), union_shape(s)
    _read_number(src, depth, branch, signed=False)
    names = {i: f"member{k}" for k, (i, _) in enumerate(s.members)}
    for n, (i, t) in enumerate(sorted(enumerate(s.types), key=lambda x: x[0] == s.null_branch)):  # values are more frequent than nulls
        src.add(depth, f"{'elif' if n else 'if'} {branch} == {2 * i}:")
        _gen_read(src, t, depth + 1, out)
        if shape == "double" and i in names:
            src.add(depth + 1, f"{out} = float({out})")
        if shape == "members" and i in names:
            src.add(depth + 1, f"{out} = {{{names[i]!r}: {out}}}")
    src.add(depth, "else:" if s.types else "if True:", f"    bad(f'the union has no branch {{({branch} >> 1) ^ -({branch} & 1)}}')")


def _gen_read_logical(src: _Source, s: Logical, depth: int, out: str) -> None:
    _gen_read(src, s.base, depth, out)
    name = s.logical
    if name == "decimal":
        order = "little" if s.little else "big"
        if s.precision <= 38:
            src.add(depth, f"{out} = Decimal(as_int({out}, '{order}', signed=True)).scaleb(-{s.scale}, {src.keep(decimal.Context(prec=80))})")
    elif name == "duration":
        src.add(depth, f"{out} = dict(zip(('months', 'days', 'millis'), i3.unpack({out})))", f"if max({out}.values()) > 2147483647: bad('a duration beyond 31 bits')")
    elif name == "time-millis":
        src.add(depth, f"{out} *= 1000000")
    elif name == "time-micros":
        src.add(depth, f"{out} *= 1000")
    elif name in ("timestamp-millis", "local-timestamp-millis"):
        src.add(depth, f"{out} *= 1000")
    if name.startswith("time-"):
        src.add(depth, f"if not 0 <= {out} < 86400000000000: bad('a time beyond the day')")


def _gen_skip(src: _Source, s: Schema, depth: int) -> None:
    if isinstance(s, Logical):
        return _gen_skip(src, s.base, depth)
    if isinstance(s, Record):
        for f in s.fields:
            _gen_skip(src, f.type, depth)
    elif isinstance(s, Fixed):
        _read_span(src, depth, str(s.size))
    elif isinstance(s, Enum):
        _read_number(src, depth, src.name(), signed=False)
    elif isinstance(s, Union):
        branch = src.name()
        _read_number(src, depth, branch, signed=False)
        for i, t in enumerate(s.types):
            src.add(depth, f"{'if' if i == 0 else 'elif'} {branch} == {2 * i}:", "    pass")
            _gen_skip(src, t, depth + 1)
        src.add(depth, "else:" if s.types else "if True:", f"    bad(f'the union has no branch {{({branch} >> 1) ^ -({branch} & 1)}}')")
    elif isinstance(s, Array | Map):
        n, size = src.name(), src.name()
        src.add(depth, "while True:")
        _read_number(src, depth + 1, n)
        src.add(depth + 1, f"if {n} == 0: break", f"if {n} < 0:")
        _read_number(src, depth + 2, size)
        _read_span(src, depth + 2, size)
        src.add(depth + 2, "continue")
        src.add(depth + 1, f"for _ in range({n}):", "    pass")
        if isinstance(s, Map):
            _gen_skip(src, Primitive("string"), depth + 2)
        _gen_skip(src, s.values if isinstance(s, Map) else s.items, depth + 2)
    elif s.kind in ("int", "long"):
        _read_number(src, depth, src.name(), signed=False)
    elif s.kind in ("bytes", "string"):
        size = src.name()
        _read_number(src, depth, size)
        _read_span(src, depth, size)
    elif s.kind != "null":
        _read_span(src, depth, {"boolean": "1", "float": "4", "double": "8"}[s.kind])


def decoder(s: Schema) -> Callable[[bytes, int, int], tuple[object, int]]:
    """run(buf, pos, end) -> (value, position after it)."""
    src = _Source()
    _gen_read(src, s, 1, "out")
    src.add(1, "return out, pos")
    return _guarded(src.function("def run(buf, pos, end):"))


def skipper(s: Schema) -> Callable[[bytes, int, int], int]:
    """run(buf, pos, end) -> position after the value, which is not decoded."""
    src = _Source()
    _gen_skip(src, s, 1)
    src.add(1, "return pos")
    return _guarded(src.function("def run(buf, pos, end):"))


def columns_decoder(record: Record, wanted: list[str]) -> Callable[[bytes, int, int, int], tuple[list[list], int]]:
    """run(buf, pos, end, rows) -> (a list for each wanted field, position after the rows). Other fields are skipped."""
    src = _Source()
    columns = {n: f"c{k}" for k, n in enumerate(wanted)}
    src.add(1, *(f"{c} = []; {c}_add = {c}.append" for c in columns.values()))
    src.add(1, "for _ in range(rows):", "    pass")
    for f in record.fields:
        if f.name in columns:
            v = src.name()
            _gen_read(src, f.type, 2, v)
            src.add(2, f"{columns[f.name]}_add({v})")
        else:
            _gen_skip(src, f.type, 2)
    src.add(1, f"return [{', '.join(columns.values())}], pos")
    return _guarded(src.function("def run(buf, pos, end, rows):"))


# -- encode and size ----------------------------------------------------------------------------


def _write_number(src: _Source, depth: int, z: str) -> None:
    src.add(depth, f"out += small[{z}] if {z} < 16384 else varint({z})")


def _write_int(src: _Source, depth: int, x: str, kind: str = "long") -> None:
    z, bits = src.name(), 31 if kind == "int" else 63
    src.add(depth, f"{z} = ({x} << 1) ^ ({x} >> 63)", f"if {z} >> {bits + 1}: too_long({kind!r}, {x})")
    _write_number(src, depth, z)


def _gen_write(src: _Source, s: Schema, depth: int, x: str) -> None:
    if not isinstance(s, Union) and s != Primitive("null"):
        src.add(depth, f"if {x} is None: bad('null under a schema without null', EncodeError)")
    if isinstance(s, Primitive):
        _gen_write_primitive(src, s.kind, depth, x)
    elif isinstance(s, Fixed):
        src.add(depth, f"if len({x}) != {s.size}: bad(f'fixed {s.name} takes {s.size} bytes, not {{len({x})}}', EncodeError)", f"out += {x}")
    elif isinstance(s, Enum):
        n = src.name()
        src.add(depth, f"{n} = {src.keep({v: 2 * i for i, v in enumerate(s.symbols)})}.get({x})", f"if {n} is None: bad(f'enum {s.name} has no symbol {{{x}!r}}', EncodeError)")
        _write_number(src, depth, n)
    elif isinstance(s, Array | Map):
        rest, item = src.name(), src.name()
        pairs = src.name()
        src.add(depth, f"{pairs} = {x}.items() if isinstance({x}, dict) else {x}" if isinstance(s, Map) else f"{pairs} = {x}")
        src.add(depth, f"if len({pairs}):", f"    {rest} = out; out = bytearray()")
        if isinstance(s, Map):
            key = src.name()
            src.add(depth + 1, f"for {key}, {item} in {pairs}:")
            _gen_write(src, Primitive("string"), depth + 2, key)
            _gen_write(src, s.values, depth + 2, item)
        else:
            src.add(depth + 1, f"for {item} in {pairs}:")
            _gen_write(src, s.items, depth + 2, item)
        size = src.name()  # one block of known size: minus the count, then the bytes
        src.add(depth + 1, f"{size} = out; out = {rest}", f"out += varint(2 * len({pairs}) - 1); out += varint(2 * len({size})); out += {size}")
        src.add(depth, "out.append(0)")
    elif isinstance(s, Record):
        for f in s.fields:
            v = src.name()
            src.add(depth, f"{v} = {x}[{f.name!r}]")
            _gen_write(src, f.type, depth, v)
    elif isinstance(s, Union):
        _gen_write_union(src, s, depth, x)
    else:
        _gen_write_logical(src, s, depth, x)


def _gen_write_primitive(src: _Source, kind: str, depth: int, x: str) -> None:
    if kind == "null":
        src.add(depth, f"if {x} is not None: bad('a value under null', EncodeError)")
    elif kind == "boolean":
        src.add(depth, f"out.append(1 if {x} else 0)")
    elif kind in ("int", "long"):
        _write_int(src, depth, x, kind)
    elif kind in ("float", "double"):
        src.add(depth, f"out += f{4 if kind == 'float' else 8}.pack({x})")
    else:
        if kind == "string":
            y = src.name()
            src.add(depth, f"{y} = {x}.encode() if isinstance({x}, str) else str({x}).encode()")
            x = y
        n = src.name()
        src.add(depth, f"{n} = 2 * len({x})")
        _write_number(src, depth, n)
        src.add(depth, f"out += {x}")


def _gen_write_union(src: _Source, s: Union, depth: int, x: str) -> None:
    shape, null = union_shape(s), s.null_branch
    src.add(depth, f"if {x} is None:", f"    out.append({2 * null})" if null is not None else "    bad('null under a union without null', EncodeError)")
    if shape == "null":
        src.add(depth, "else:", "    bad('a value under null', EncodeError)")
    elif shape == "members":
        for k, (i, t) in enumerate(s.members):
            v = src.name()
            src.add(depth, f"elif {x}.get('member{k}') is not None:", f"    {v} = {x}['member{k}']; out += small[{2 * i}]")
            _gen_write(src, t, depth + 1, v)
        src.add(depth, "else:", "    bad('no member of the union is set', EncodeError)")
    else:
        # Of int and long the narrowest that holds the value; of float and double the wide one.
        chosen = s.members
        if shape == "double":
            chosen = [m for m in s.members if m[1].kind == "double"]
        elif shape == "long":
            chosen = sorted(s.members, key=lambda m: m[1].kind)
        for at, (i, t) in enumerate(chosen):
            fits = f" -2147483648 <= {x} <= 2147483647" if at + 1 < len(chosen) else ""
            src.add(depth, f"elif{fits}:" if fits else "else:", f"    out += small[{2 * i}]")
            _gen_write(src, t, depth + 1, x)


def _gen_write_logical(src: _Source, s: Logical, depth: int, x: str) -> None:
    name, y = s.logical, src.name()
    if name == "decimal" and s.precision <= 38:
        exact = src.keep(decimal.Context(prec=80, traps=[decimal.Inexact, decimal.InvalidOperation]))
        src.add(
            depth,
            f"try: {y} = int({x}.scaleb({s.scale}, {exact}).to_integral_exact(None, {exact}))",
            f"except ArithmeticError: bad(f'{{{x}}} has more than {s.scale} decimals', EncodeError)",
            f"if abs({y}) >= {10**s.precision}: bad(f'{{{x}}} has more than {s.precision} digits', EncodeError)",
        )
        order = "little" if s.little else "big"
        if isinstance(s.base, Fixed):
            src.add(depth, f"try: {y} = {y}.to_bytes({s.base.size}, '{order}', signed=True)", "except OverflowError: bad('the decimal does not fit its bytes', EncodeError)")
        else:
            src.add(depth, f"{y} = {y}.to_bytes(({y} if {y} >= 0 else ~{y}).bit_length() // 8 + 1, 'big', signed=True)")
    elif name == "duration":
        src.add(depth, f"{y} = ({x}['months'], {x}['days'], {x}['millis'])", f"if min({y}) < 0 or max({y}) > 2147483647: bad('a duration is not negative and below 2**31', EncodeError)", f"{y} = i3.pack(*{y})")
    elif name == "uuid":
        src.add(depth, f"{y} = str({x}).lower()", f"if not uuid_form({y}): bad(f'{{{y}}} is no uuid', EncodeError)")
    elif name == "time-millis":
        src.add(depth, f"{y} = {x} // 1000000")
    elif name in ("time-micros", "timestamp-millis", "local-timestamp-millis"):
        src.add(depth, f"{y} = {x} // 1000")  # earlier than the epoch too: floor
    else:
        y = x
    _gen_write(src, s.base, depth, y)


def encoder(s: Schema) -> Callable[[object], bytes]:
    """run(value) -> bytes."""
    src = _Source()
    src.add(1, "out = bytearray()")
    _gen_write(src, s, 1, "x")
    src.add(1, "return bytes(out)")
    return src.function("def run(x):")


def rows_encoder(record: Record) -> Callable[..., list[bytes]]:
    """run(a list for each field) -> the rows' bytes, one bytes object each."""
    src = _Source()
    names = [f"x{k}" for k in range(len(record.fields))]
    one = f"for {', '.join(names)}, in zip({', '.join(f'columns[{k}]' for k in range(len(names)))}):" if names else "for _ in range(rows):"
    src.add(1, "done = []", one, "    out = bytearray()")
    for f, x in zip(record.fields, names, strict=True):
        _gen_write(src, f.type, 2, x)
    src.add(2, "done.append(bytes(out))")
    src.add(1, "return done")
    return src.function("def run(columns, rows):")


def _varint_size(z: int) -> int:
    return max(1, (z.bit_length() + 6) // 7)


def encoded_size(s: Schema, x: object) -> int:
    """How many bytes the encoding of a physical value has, without making it (but for decimals' unscaled integers)."""
    if isinstance(s, Primitive):
        if s.kind in ("int", "long"):
            return _varint_size(zigzag(x))
        if s.kind in ("bytes", "string"):
            n = len(x.encode() if isinstance(x, str) else x)
            return _varint_size(2 * n) + n
        return {"null": 0, "boolean": 1, "float": 4, "double": 8}[s.kind]
    if isinstance(s, Fixed):
        return s.size
    if isinstance(s, Enum):
        return _varint_size(2 * s.symbols.index(x))
    if isinstance(s, Record):
        return sum(encoded_size(f.type, x[f.name]) for f in s.fields)
    if isinstance(s, Array | Map):
        if isinstance(s, Map):
            pairs = x.items() if isinstance(x, dict) else x
            n, inner = len(x), sum(encoded_size(Primitive("string"), k) + encoded_size(s.values, v) for k, v in pairs)
        else:
            n, inner = len(x), sum(encoded_size(s.items, v) for v in x)
        return 1 + (_varint_size(2 * n - 1) + _varint_size(2 * inner) + inner if n else 0)
    if isinstance(s, Union):
        if x is None:
            return 1
        shape = union_shape(s)
        if shape == "members":
            k, (i, t) = next((k, m) for k, m in enumerate(s.members) if x.get(f"member{k}") is not None)
            return _varint_size(2 * i) + encoded_size(t, x[f"member{k}"])
        members = s.members
        if shape == "double":
            members = [m for m in members if m[1].kind == "double"]
        elif shape == "long":
            members = [m for m in members if m[1].kind == ("int" if -(1 << 31) <= x < 1 << 31 else "long")]
        return _varint_size(2 * members[0][0]) + encoded_size(members[0][1], x)
    if isinstance(s.base, Fixed):
        return s.base.size
    if s.logical in ("date",):
        return encoded_size(s.base, x)
    if s not in _ENCODERS:  # compiling one takes far longer than running it
        _ENCODERS[s] = encoder(s)
    return len(_ENCODERS[s](x))


def encode(s: Schema, x: object) -> bytes:
    """The encoding of one host or physical value."""
    return encoder(s)(host_value(s, x))


def decode(s: Schema, data: bytes) -> object:
    """The physical value that the bytes begin with."""
    return decoder(s)(bytes(data), 0, len(data))[0]


#: Types of the user's that are carried by another: how their values become that type's.
LOWERED: dict[type, Callable[[object], object]] = {}


def host_value(s: Schema, x: object) -> object:
    """Dates, times, UUIDs, enums, lowered types and nested ones of them in physical form; other values as they are."""
    while type(x) in LOWERED:
        x = LOWERED[type(x)](x)
    if x is None:
        return None
    if isinstance(s, Enum) and isinstance(x, enum.Enum):
        return x.name
    if isinstance(s, Array):
        return [host_value(s.items, v) for v in x]
    if isinstance(s, Map):
        return [(k, host_value(s.values, v)) for k, v in (x.items() if isinstance(x, dict) else x)]
    if isinstance(s, Record):
        if isinstance(x, tuple) and not hasattr(x, "_fields"):
            x = {f"_{k}": v for k, v in enumerate(x, 1)}
        get = x.__getitem__ if isinstance(x, dict) else lambda n: getattr(x, n)
        return {f.name: host_value(f.type, get(f.name)) for f in s.fields}
    if isinstance(s, Union):
        if union_shape(s) == "members":
            return {k: host_value(t, x.get(k)) for k, (_, t) in zip((f"member{i}" for i in range(len(s.members))), s.members, strict=True)}
        return host_value(s.members[0][1], x) if s.members else x
    if isinstance(s, Logical):
        if isinstance(x, datetime.datetime):
            zone = datetime.UTC if x.tzinfo else None
            return (x - datetime.datetime(1970, 1, 1, tzinfo=zone)) // datetime.timedelta(microseconds=1)
        if isinstance(x, datetime.date):
            return (x - datetime.date(1970, 1, 1)).days
        if isinstance(x, datetime.time):
            return ((x.hour * 60 + x.minute) * 60 + x.second) * 10**9 + x.microsecond * 1000
        if isinstance(x, uuid.UUID):
            return str(x)
    return x
