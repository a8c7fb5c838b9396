"""The column encoder against the row codec, and its blocks."""

import io

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrow import columns, container, wire
from quillrow import schema as S
from quillrow.arrow import to_values
from quillrow.sources.container_source import write_batches

TYPES = {
    '"int"': (pa.int32(), st.integers(-(2**31), 2**31 - 1)),
    '"long"': (pa.int64(), st.integers(-(2**63), 2**63 - 1) | st.integers(-70, 70)),
    '"float"': (pa.float32(), st.floats(width=32, allow_nan=False)),
    '"double"': (pa.float64(), st.floats(allow_nan=False)),
    '"boolean"': (pa.bool_(), st.booleans()),
    '"string"': (pa.string(), st.text(max_size=20)),
    '"bytes"': (pa.binary(), st.binary(max_size=200)),
    '{"type":"int","logicalType":"date"}': (pa.date32(), st.integers(-100_000, 100_000)),
    '{"type":"long","logicalType":"timestamp-micros"}': (pa.timestamp("us", "UTC"), st.integers(-(10**15), 10**15)),
    '{"type":"long","logicalType":"timestamp-millis"}': (pa.timestamp("us", "UTC"), st.integers(-(10**15), 10**15)),
    '{"type":"long","logicalType":"local-timestamp-micros"}': (pa.timestamp("us"), st.integers(-(10**15), 10**15)),
    '{"type":"long","logicalType":"local-timestamp-millis"}': (pa.timestamp("us"), st.integers(-(10**15), 10**15)),
}


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_columns_equal_rows(data):
    rows, fields, arrays = data.draw(st.integers(0, 30)), [], []
    for k in range(data.draw(st.integers(1, 5))):
        schema = data.draw(st.sampled_from(sorted(TYPES)))
        kind, values = TYPES[schema]
        union = data.draw(st.sampled_from(["", '["null",%s]', '[%s,"null"]']))
        own = data.draw(st.lists(values if not union else values | st.none(), min_size=rows, max_size=rows))
        sliced = data.draw(st.booleans())
        array = pa.array([*own[:1], *own] if sliced and rows else own, kind)
        arrays.append(array[1:] if sliced and rows else array)
        fields.append(f'{{"name":"f{k}","type":{union % schema if union else schema}}}')
    record = S.parse(f'{{"type":"record","name":"r","fields":[{",".join(fields)}]}}')
    assert columns.supported(record)
    expected = wire.rows_encoder(record)([to_values(a) for a in arrays], rows)
    found = columns.rows_of(record, arrays, rows)
    if found is not None:
        whole, ends = found
        starts = [0, *ends.tolist()[:-1]]
        assert [bytes(whole[a:b]) for a, b in zip(starts, ends.tolist(), strict=False)] == expected


@pytest.mark.parametrize("block", [1, 50, 1000, 10**6])
def test_same_blocks_either_way(block, monkeypatch):
    rng = np.random.default_rng(1)
    record = S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":"long"},{"name":"s","type":["null","string"]}]}')
    batches = [pa.RecordBatch.from_pydict({"a": pa.array(rng.integers(-(2**40), 2**40, n)), "s": pa.array([None if k % 3 == 0 else "x" * (k % 9) for k in range(n)], pa.string())}) for n in (0, 1, 300, 7)]
    written = []
    for by_columns in (True, False):
        monkeypatch.setattr(columns, "supported", lambda r, answer=by_columns: answer)
        out = io.BytesIO()
        writer = container.Writer(out, record, "deflate", block, sync=bytes(16))
        write_batches(writer, record, iter(batches))
        assert writer.rows == 308
        written.append(out.getvalue())
    assert written[0] == written[1]


def test_what_is_left_to_the_row_codec():
    nested = S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":{"type":"array","items":"long"}}]}')
    flat = S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":"string"}]}')
    assert not columns.supported(nested) and columns.supported(flat)
    assert columns.rows_of(flat, [pa.array(["x" * 10_000] * 200)], 200) is None
    assert columns.rows_of(flat, [pa.array(["x", None])], 2) is None
