import dataclasses
import datetime
import enum

import pytest
from pyspark.sql import types as T

from quillrow import derive
from quillrow import schema as S
from quillrow.errors import SchemaError


def test_equality_ignores_what_codecs_do_not_use():
    a = S.parse('{"type":"record","name":"r","namespace":"x.y","doc":"d","aliases":["q"],"fields":[{"name":"a","type":"long","default":1,"order":"ignore","doc":"z"}]}')
    b = S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":{"type":"long"}}]}')
    assert a == b and a.full_name == "x.y.r"
    assert S.parse(S.render(a)).fields[0].default == 1 and '"order":"ignore"' in S.render(a)


def test_named_references_and_recursion():
    s = S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":{"type":"fixed","name":"f","size":2}},{"name":"b","type":"f"}]}')
    assert s.fields[1].type == S.Fixed("f", 2)
    assert S.parse(S.render(s)) == s
    with pytest.raises(SchemaError, match="recursive"):
        S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":["null","r"]}]}')


@pytest.mark.parametrize("text", ["nonsense", '{"type":"array"}', '{"type":"enum","name":"e","symbols":["a b"]}', '{"type":"enum","name":"e","symbols":["a","a"]}', "[[\"null\"]]", '{"name":"x"}'])
def test_bad_schemas_raise(text):
    with pytest.raises(SchemaError):
        S.parse(text)


def test_unknown_logical_types_are_their_carrier():
    assert S.parse('{"type":"int","logicalType":"moon-phase"}') == S.INT
    assert S.parse('{"type":"string","logicalType":"date"}') == S.STRING


def test_spark_types_there_and_back():
    struct = T.StructType(
        [
            T.StructField("a", T.IntegerType(), False),
            T.StructField("b", T.ArrayType(T.StringType(), True)),
            T.StructField("c", T.MapType(T.StringType(), T.DoubleType(), False), False),
            T.StructField("d", T.DecimalType(20, 3)),
            T.StructField("e", T.StructType([T.StructField("x", T.TimestampNTZType()), T.StructField("y", T.TimestampType(), False)])),
            T.StructField("f", T.DateType()),
        ]
    )
    record = S.from_spark(struct)
    back = S.to_spark(record)
    assert back.simpleString() == struct.simpleString() and [f.nullable for f in back] == [f.nullable for f in struct]
    assert S.from_spark(back) == record


def test_metadata_keeps_what_spark_cannot_say():
    record = S.parse('{"type":"record","name":"row","fields":[{"name":"e","type":{"type":"enum","name":"e","symbols":["a"]}},{"name":"u","type":["string","null"]},{"name":"m","type":["long","string"]},{"name":"t","type":{"type":"int","logicalType":"time-millis"}}]}')
    assert S.from_spark(S.to_spark(record)) == record


def test_union_shapes():
    shape = lambda text: S.spark_type(S.parse(text))[0].simpleString()
    assert [shape(x) for x in ('["null","int"]', '["int","long"]', '["float","null","double"]', '["long","string"]', '["null"]')] == [
        "int",
        "bigint",
        "double",
        "struct<member0:bigint,member1:string>",
        "void",
    ]


def test_python_types():
    class Color(enum.Enum):
        red = 1
        blue = 2

    @dataclasses.dataclass
    class Inner:
        day: datetime.date

    @dataclasses.dataclass
    class Person:
        id: int
        name: str | None
        tags: list[str]
        inner: Inner
        pair: tuple[int, float]

    Person.__annotations__["inner"] = Inner
    with pytest.raises(NameError):
        derive.schema_of(dataclasses.make_dataclass("Bad", [("x", "Missing")]))
    s = derive.schema_of(dataclasses.make_dataclass("Person", [("id", int), ("name", str | None), ("tags", list[str]), ("color", Color), ("pair", tuple[int, float])]))
    assert s.name == "Person" and s.fields[1].type == S.Union((S.NULL, S.STRING))
    assert s.fields[3].type == S.Enum("Color", ("red", "blue")) and [f.name for f in s.fields[4].type.fields] == ["_1", "_2"]
    assert S.Enum("Color", ("red", "blue")).shown() == ["red = 0", "blue = 1"]
