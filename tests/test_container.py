import datetime
import decimal
import io

import pytest

from quillrow import container as C
from quillrow import schema as S
from quillrow import wire
from quillrow.errors import ContainerError, RowFormatError

ABC = S.parse('{"type":"record","name":"R","fields":[{"name":"a","type":"long"},{"name":"b","type":"long"},{"name":"c","type":"long"}]}')
ROWS = [{"a": 1, "b": 2, "c": 3}] * 3
CODECS = ["null", "deflate", "bzip2", "xz", "zstandard"]


@pytest.mark.parametrize("codec", CODECS)
def test_codecs(codec):
    record, rows = C.read_bytes(C.write_bytes(ABC, ROWS, codec))
    assert record == ABC and rows == ROWS
    assert C.read_bytes(C.write_bytes(ABC, [], codec)) == (ABC, [])


@pytest.mark.parametrize("split", [1, 7, 50, 333, 10**6])
def test_byte_ranges_hold_each_block_once(split):
    data = C.write_bytes(ABC, [{"a": i, "b": -i, "c": i * i} for i in range(500)], "deflate", block_bytes=64)
    file = io.BytesIO(data)
    header = C.read_header(file)
    found = [b.offset for a in range(0, len(data), split) for b in C.blocks(file, header, a, min(a + split, len(data)), with_data=False)]
    assert found == [b.offset for b in C.blocks(file, header)] and len(found) > 5


def test_damage_is_found():
    data = C.write_bytes(ABC, ROWS)
    for bad in (b"XXXX" + data[4:], data[:-1] + bytes([data[-1] ^ 1]), data[:-5], data[:10], data.replace(b"avro.schema", b"avro.schemo")):
        with pytest.raises(ContainerError):
            C.read_bytes(bad)
    with pytest.raises(ContainerError, match="snappy"):
        C.write_bytes(ABC, ROWS, "snappy")
    meta = wire.encoder(S.Map(S.BYTES))([("avro.schema", S.render(ABC).encode()), ("avro.codec", b"lz9")])
    with pytest.raises(ContainerError, match="lz9"):
        C.read_bytes(b"Obj\x01" + meta + b"s" * 16)


def _file(record_json, body, rows, codec=None, padding=b""):
    meta = [("avro.schema", record_json.encode())] + ([("avro.codec", codec.encode())] if codec else [])
    data = C.compress(codec or "null", body) + padding
    return b"Obj\x01" + wire.encoder(S.Map(S.BYTES))(meta) + b"s" * 16 + wire.varint(2 * rows) + wire.varint(2 * len(data)) + data + b"s" * 16


def test_dialects():
    body = b"\x02\x04\x06"
    assert C.read_bytes(_file(S.render(ABC), body, 1, padding=b"junk"))[1] == [ROWS[0]]
    assert C.read_bytes(_file(S.render(ABC), body, 1, codec="zstd"))[1] == [ROWS[0]]
    unnamed = '{"type":"record","name":"R","fields":[{"name":"d","type":{"type":"fixed","size":16,"logicalType":"decimal","precision":4,"scale":1}}]}'
    assert C.read_bytes(_file(unnamed, b"\x05" + b"\0" * 15, 1))[1] == [{"d": decimal.Decimal("0.5")}]
    assert C.read_bytes(_file('"long"', b"\x02\x04", 2))[1] == [{"value": 1}, {"value": 2}]


def test_java_reads_and_writes(spark, tmp_path):
    jvm = spark._jvm
    try:
        avro = jvm.org.apache.avro
        parser = getattr(avro, "Schema$Parser")()
    except TypeError:
        pytest.skip("no Java implementation on the class path")
    record = S.parse(
        '{"type":"record","name":"R","fields":[{"name":"a","type":["null","long"]},{"name":"s","type":"string"},'
        '{"name":"xs","type":{"type":"array","items":"double"}},{"name":"m","type":{"type":"map","values":"int"}},'
        '{"name":"d","type":{"type":"int","logicalType":"date"}},{"name":"p","type":{"type":"fixed","name":"p_","size":8,"logicalType":"decimal","precision":9,"scale":2}}]}'
    )
    rows = [{"a": None if i % 3 == 0 else i, "s": "é" * i, "xs": [0.5] * i, "m": {"k": i}, "d": datetime.date(2020, 1, 1 + i), "p": decimal.Decimal(i).scaleb(-2)} for i in range(20)]
    for codec in CODECS:
        path = tmp_path / f"{codec}.bin"
        path.write_bytes(C.write_bytes(record, rows, codec, block_bytes=100))
        reader = avro.file.DataFileReader(jvm.java.io.File(str(path)), avro.generic.GenericDatumReader())
        assert parser is not None and reader.getSchema().getName() == "R"
        out = str(tmp_path / f"{codec}.java")
        writer = avro.file.DataFileWriter(avro.generic.GenericDatumWriter(reader.getSchema()))
        writer.setCodec(avro.file.CodecFactory.fromString(codec))
        writer.create(reader.getSchema(), jvm.java.io.File(out))
        n = 0
        while reader.hasNext():
            datum = reader.next()
            if n == 4:
                assert str(datum.get("s")) == "éééé" and datum.get("a") == 4
            writer.append(datum)
            n += 1
        writer.close()
        assert n == 20
        back = C.read_bytes(open(out, "rb").read())[1]
        assert back == [wire.host_value(record, r) for r in rows]


def test_errors_are_one_family():
    assert issubclass(ContainerError, RowFormatError)
