import datetime

import pytest
from pyspark.sql import functions as F

from quillrow import container as C
from quillrow import runtime
from quillrow import schema as S
from quillrow.functions.codec import encoded_size, from_binary, to_binary
from quillrow.operators import table as tables
from quillrow.session import install
from quillrow.streaming.containers import read_container_stream, write_container_batch


@pytest.fixture
def frame(spark):
    return spark.range(1000).select(
        "id",
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("é"), "id")).alias("s"),
        F.array("id", F.lit(None).cast("long")).alias("xs"),
        F.create_map(F.lit("k"), F.col("id") / 2).alias("m"),
        F.struct(F.timestamp_micros(F.col("id") * 7).alias("t"), F.date_from_unix_date(F.col("id").cast("int") - 500).alias("d")).alias("inner"),
        (F.col("id") - 500).cast("decimal(12,3)").alias("p"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.col("id").cast("float").alias("f"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("raw"),
        F.lit(None).alias("nothing"),
    )


@pytest.mark.parametrize("codec", ["null", "deflate", "zstandard"])
def test_round_trip(spark, frame, tmp_path, codec):
    path = tables.container_writer(str(tmp_path / "t"), compression=codec, blockBytes=500)(frame)
    back = tables.read_container(spark, path, splitBytes=900)
    assert back.schema.simpleString() == frame.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    assert tables.row_count(spark, path).first()["n"] == 1000
    assert tables.read_container(spark, path, columns=["p", 0]).columns == ["p", "id"]
    assert tables.read_container(spark, path, columns=["inner"]).filter("inner.d = date'1970-01-01'").count() == 1
    assert tables.read_container(spark, path).count() == 1000
    row = tables.row_at(spark, path, 777)
    assert row.count() == 1 and row.columns == frame.columns
    with pytest.raises(IndexError):
        tables.row_at(spark, path, 1000)


def test_modes_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_container(spark.range(0), path)
    assert tables.read_container(spark, path).count() == 0
    tables.write_container(spark.range(5), path)
    assert tables.read_container(spark, path).count() == 5
    tables.write_container(spark.range(2), path, mode="overwrite")
    assert tables.read_container(spark, path).count() == 2
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]


def test_explicit_schema(spark, tmp_path):
    schema = '{"type":"record","name":"r","fields":[{"name":"e","type":{"type":"enum","name":"e","symbols":["x","y"]}},{"name":"t","type":["long","null"]}]}'
    df = spark.createDataFrame([("x", 1), ("y", None)], "e string, t long")
    path = tables.write_container(df, str(tmp_path / "t"), schema_json=schema)
    back = tables.read_container(spark, path)
    assert sorted(back.collect()) == sorted(df.collect())
    assert tables.container_schema(path) == S.parse(schema)
    assert S.from_spark(back.schema).fields == S.parse(schema).fields
    with pytest.raises(Exception, match="no symbol"):
        tables.write_container(spark.createDataFrame([("z", 1)], "e string, t long"), str(tmp_path / "u"), schema_json=schema)


def test_time_columns(spark, tmp_path):
    from quillrow.session import install

    install(spark)
    df = spark.sql("select time'01:02:03.123456' as t, id from range(3)")
    path = tables.write_container(df, str(tmp_path / "t"))
    assert tables.read_container(spark, path).first()["t"] == datetime.time(1, 2, 3, 123456)


def test_values_as_containers(spark, frame, tmp_path):
    schema = S.render(S.from_spark(frame.schema))
    packed = tables.to_container_column(frame, "xz")
    assert packed.agg(F.sum("rows")).first()[0] == 1000
    assert tables.from_container_column(packed, "container", schema).agg(F.sum("id")).first()[0] == 499500
    path = tables.write_container(frame, str(tmp_path / "t"))
    assert tables.read_binary_files(spark, path, schema).agg(F.sum("id")).first()[0] == 499500


@pytest.mark.parametrize(
    "schema,value",
    [
        ("long", "id * 1000003 - 500"),
        ("int", "cast(id - 500 as int)"),
        ("boolean", "id % 2 = 0"),
        ("string", "concat('é', id)"),
        ("bytes", "cast(cast(id as string) as binary)"),
        ('["null","string"]', "case when id % 2 = 0 then cast(id as string) end"),
        ('["long","null"]', "case when id % 2 = 0 then id end"),
        ('{"type":"int","logicalType":"date"}', "date_from_unix_date(cast(id - 500 as int))"),
        ('{"type":"long","logicalType":"local-timestamp-micros"}', "timestampadd(MICROSECOND, id - 500, timestamp_ntz'1970-01-01')"),
        ('{"type":"long","logicalType":"local-timestamp-millis"}', "timestampadd(MICROSECOND, (id - 500) * 1000, timestamp_ntz'1970-01-01')"),
        ('{"type":"long","logicalType":"timestamp-micros"}', "timestamp_micros(id - 500)"),
        ('{"type":"enum","name":"e","symbols":["a","b"]}', "case when id % 2 = 0 then 'a' else 'b' end"),
        ('{"type":"record","name":"r","fields":[{"name":"x","type":"long"},{"name":"y","type":["null","string"]}]}', "named_struct('x', id, 'y', cast(null as string))"),
    ],
)
def test_native_equals_arrow(spark, schema, value):
    rows = spark.range(0, 1000, 7).select(F.expr(value).alias("v"))
    both = rows.select("v", to_binary(F.col("v"), schema, native=True).alias("a"), to_binary(F.col("v"), schema, native=False).alias("b"), encoded_size(F.col("v"), schema).alias("n"))
    both = both.withColumns({"back": from_binary(F.col("a"), schema), "native": from_binary(F.col("a"), schema, native=True)})
    assert both.filter("not (a <=> b) or not (n <=> octet_length(a)) or not (back <=> v) or not (native <=> v)").count() == 0


@pytest.mark.parametrize(
    "schema,data",
    [
        ("long", "80"),
        ("long", ""),
        ("long", "FFFFFFFFFFFFFFFFFF02"),
        ("long", "80808080808080808080"),
        ("int", "8080808080808001"),
        ("boolean", "02"),
        ("string", "0461"),
        ("string", "02FF"),
        ("bytes", "01"),
        ("bytes", "FEFFFFFFFFFFFFFFFF01"),
        ('{"type":"fixed","name":"f","size":3}', "0102"),
        ('{"type":"enum","name":"e","symbols":["a","b"]}', "04"),
        ('["null","long"]', "04"),
        ('{"type":"record","name":"r","fields":[{"name":"x","type":"long"},{"name":"y","type":"string"}]}', "02"),
    ],
)
def test_damaged_bytes_raise_either_way(spark, schema, data):
    df = spark.createDataFrame([(bytes.fromhex(data),)], "b binary")
    for native in (True, False):
        with pytest.raises(Exception, match="end of data|more than|no int|no boolean|UTF-?8|utf-8|no symbol|no branch|out of range"):
            df.select(from_binary(F.col("b"), schema, native=native).alias("v")).collect()
    assert df.select(from_binary(F.col("b"), schema, permissive=True).alias("v")).first()[0] is None


@pytest.mark.parametrize(
    "schema,value",
    [
        ("int", "cast(1099511627776 as bigint)"),
        ("int", "cast(-2147483649 as bigint)"),
        ('{"type":"record","name":"r","fields":[{"name":"x","type":"long"},{"name":"y","type":"string"}]}', "named_struct('x', 1L, 'y', cast(null as string))"),
        ('{"type":"fixed","name":"f","size":3}', "cast('ab' as binary)"),
        ('{"type":"enum","name":"e","symbols":["a","b"]}', "'c'"),
        ('{"type":"string","logicalType":"uuid"}', "'no'"),
    ],
)
def test_values_that_a_schema_cannot_hold_raise_either_way(spark, schema, value):
    rows = spark.range(3).select(F.expr(value).alias("v"))
    for native in (True, False):
        with pytest.raises(Exception, match="no int|null under|takes 3 bytes|no symbol|no uuid"):
            rows.select(to_binary(F.col("v"), schema, native=native).alias("b")).collect()


def test_damaged_values(spark):
    df = spark.createDataFrame([(b"\x80",), (b"\x02",)], "b binary")
    assert [r[0] for r in df.select(from_binary(F.col("b"), "long", permissive=True)).collect()] == [None, 1]
    with pytest.raises(Exception, match="unexpected end"):
        df.select(from_binary(F.col("b"), "long")).collect()


def test_value_files(spark, tmp_path):
    from quillrow.operators import values

    schema = '{"type":"record","name":"r","fields":[{"name":"a","type":"long"},{"name":"d","type":{"type":"int","logicalType":"date"}}]}'
    (tmp_path / "schema.json").write_text(schema)
    for k in range(3):
        assert values.write_value(str(tmp_path / f"v{k}.bin"), {"a": k, "d": datetime.date(1970, 1, 2)}, str(tmp_path / "schema.json")) == 2
    assert values.read_value(str(tmp_path / "v2.bin"), schema) == {"a": 2, "d": 1}
    found = values.read_value_files(spark, str(tmp_path / "*.bin"), schema).select("value.*").collect()
    assert sorted(map(tuple, found)) == [(k, datetime.date(1970, 1, 2)) for k in range(3)]


def test_ragged_rows(spark, tmp_path):
    rows = [{"a": 1, "b": 2, "c": 3}, {"b": 4.0, "c": None, "d": 5}, {"a": 6, "d": 7}, {"a": 8, "b": 9, "c": 10, "d": None}, {"d": 11, "c": 10, "b": 9, "a": 8}]
    df = tables.from_ragged_rows(spark, rows)
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "bigint"), ("d", "bigint")]
    back = tables.round_trip(df)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert tables.union_ragged(spark.range(1), spark.range(1).select(F.lit("x").alias("y"))).columns == ["id", "y"]


def test_stream(spark, tmp_path):
    record = S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":"long"}]}')
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.bin").write_bytes(C.write_bytes(record, [{"a": i} for i in range(k + 1)]))
    stream = read_container_stream(spark, str(source), S.render(record), 1)
    query = stream.writeStream.foreachBatch(write_container_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert tables.read_container(spark, str(tmp_path / "out")).count() == 6


def test_stream_by_byte_ranges(spark, tmp_path):
    """Files of many blocks, read by many tasks, each row once."""
    record = S.parse('{"type":"record","name":"r","fields":[{"name":"a","type":"long"},{"name":"s","type":"string"}]}')
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.bin").write_bytes(C.write_bytes(record, [{"a": 1000 * k + i, "s": "x" * (i % 7)} for i in range(400)], "deflate", 200))
    stream = read_container_stream(spark, str(source), S.render(record), 2, split_bytes=333)
    query = stream.writeStream.foreachBatch(write_container_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = tables.read_container(spark, str(tmp_path / "out")).collect()
    assert sorted((r["a"], r["s"]) for r in rows) == [(1000 * k + i, "x" * (i % 7)) for k in range(3) for i in range(400)]


def test_scratch_is_released(spark, frame):
    import os

    from quillrow.runtime import release, scratch

    release(spark)
    path = tables.write_container(frame, scratch(spark, "container"))
    inner = path.removeprefix("file://").removeprefix("file:")
    assert os.listdir(inner) and release(spark) == 1 and not os.path.exists(inner) and release(spark) == 0


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from quillrow.runtime import shared_dir

    nothing = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master=master, applicationId="one", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(session("local-cluster[2,1,1024]"))
    assert shared_dir(session("local[2]")).startswith("file://") and shared_dir(session("local[2]")) == shared_dir(session("local"))


def test_grown_driver_heap_is_swept_after_a_step(spark, monkeypatch):
    swept = []
    monkeypatch.setattr(runtime, "sweep", swept.append)
    monkeypatch.setattr(runtime, "HEAP_SHARE", 1.1)
    runtime.checkpoint(spark.range(3))
    assert not swept
    monkeypatch.setattr(runtime, "HEAP_SHARE", 0.0)
    assert runtime.checkpoint(spark.range(3)).count() == 3
    assert runtime.materialize(spark.range(3)).count() == 3
    assert len(swept) == 2


def test_native_decoding_names_its_bytes_once(spark):
    """They may be a whole encoding, which would be computed again in every step of a record's reader."""
    record = '{"type":"record","name":"r","fields":[{"name":"a","type":"long"},{"name":"b","type":"string"},{"name":"c","type":["null","long"]}]}'
    rows = spark.createDataFrame([(b"\x02\x02b\x02\x06",), (None,)], "the_bytes binary")
    shown = rows.select(from_binary(F.col("the_bytes"), record, native=True).alias("v"))
    assert shown._jdf.queryExecution().analyzed().expressions().toString().count("the_bytes") == 1
    assert [r["v"] and tuple(r["v"]) for r in shown.collect()] == [(1, "b", 3), None]


def test_uuids_are_computed_once_and_have_no_rest(spark):
    kind = '{"type":"string","logicalType":"uuid"}'
    one = "0123ABCD-0000-0000-0000-0123456789ab"
    rows = spark.createDataFrame([(one,), (None,)], "the_id string")
    found = rows.select(to_binary(F.col("the_id"), kind).alias("b"))
    assert found._jdf.queryExecution().analyzed().expressions().toString().count("the_id") <= 3
    assert [r["b"] and bytes(r["b"]) for r in found.collect()] == [b"H" + one.lower().encode(), None]
    with pytest.raises(Exception, match="no uuid"):
        spark.createDataFrame([(one + "\n",)], "the_id string").select(to_binary(F.col("the_id"), kind)).collect()


@pytest.mark.parametrize("kind", ['{"type":"long","logicalType":"time-micros"}', '{"type":"int","logicalType":"time-millis"}'])
def test_times_are_encoded_and_sized_without_python_workers(spark, kind):
    install(spark)
    rows = spark.sql("SELECT * FROM VALUES (TIME'00:00:00'), (TIME'00:00:00.000064'), (TIME'12:34:56.789999'), (TIME'23:59:59.999999'), (NULL) AS t(t)")
    found = rows.select(encoded_size(F.col("t"), kind).alias("n"), to_binary(F.col("t"), kind).alias("b"), to_binary(F.col("t"), kind, native=False).alias("a"))
    assert "ArrowEvalPython" not in rows.select(encoded_size(F.col("t"), kind), to_binary(F.col("t"), kind))._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert r["b"] == r["a"] and r["n"] == (r["a"] if r["a"] is None else len(r["a"]))
