"""The registered queries of the row format, and the DuckDB SQL each must equal."""

from __future__ import annotations

import dataclasses
import datetime
import enum
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrow import schema as S
from quillrow.container import filesystem
from quillrow.derive import decode_as, lowers, schema_of
from quillrow.functions.codec import duration_interval, encoded_size, from_binary, native_reader, to_binary
from quillrow.operators.table import (
    as_dict,
    block_index,
    container_writer,
    element,
    from_container_column,
    read_binary_files,
    read_container,
    round_trip,
    row_at,
    row_count,
    to_container_column,
    union_ragged,
    write_container,
)
from quillrow.operators.values import read_value, read_value_files, write_value
from quillrow.runtime import scratch
from quillrow.session import install
from quillrow.wire import encode

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return install(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _path(spark: SparkSession) -> str:
    return scratch(spark, "container")


# -- scans and sinks ----------------------------------------------------------------------------

for _name in TABLES:
    query(f"scan_{_name}", f"SELECT * FROM {_name}")(lambda spark, d, n=_name: round_trip(table(spark, d, n)))
for _codec in ("null", "deflate", "bzip2", "xz", "zstandard"):
    query(f"codec_{_codec}_orders", "SELECT * FROM orders")(lambda spark, d, c=_codec: round_trip(table(spark, d, "orders"), compression=c))


@query("project_lineitem", "SELECT l_orderkey, l_shipdate FROM lineitem")
def project_lineitem(spark, d):
    return round_trip(table(spark, d, "lineitem"), ["l_orderkey", "l_shipdate"])


@query("project_by_place", "SELECT o_totalprice, o_orderkey FROM orders")
def project_by_place(spark, d):
    return round_trip(table(spark, d, "orders"), [3, 0])


@query("row_count_lineitem", "SELECT count(*) AS n FROM lineitem")
def row_count_lineitem(spark, d):
    return row_count(spark, write_container(table(spark, d, "lineitem"), _path(spark)))


@query("row_at_nation", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 7")
def row_at_nation(spark, d):
    ordered = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    return row_at(spark, write_container(ordered, _path(spark), blockBytes=64), 7)


@query("block_index_lineitem", "SELECT count(*) AS n, true AS rising FROM lineitem")
def block_index_lineitem(spark, d):
    """The index adds up to the table, and blocks follow one another."""
    index = block_index(spark, write_container(table(spark, d, "lineitem"), _path(spark), blockBytes=20_000))
    order = Window.partitionBy("_file").orderBy("_block")
    return index.withColumn("rises", F.col("_block") > F.coalesce(F.lag("_block").over(order), F.lit(0))).agg(F.sum("_rows").alias("n"), F.bool_and(F.col("rises") & (F.col("_rows") > 0)).alias("rising"))


@query("curried_sink_orders", "SELECT * FROM orders")
def curried_sink_orders(spark, d):
    return read_container(spark, container_writer(_path(spark), compression="deflate")(table(spark, d, "orders")))


@query("row_dicts_nation", "SELECT * FROM nation")
def row_dicts_nation(spark, d):
    """Rows materialised on the driver as dicts, and a table of these."""
    nation = table(spark, d, "nation")
    return spark.createDataFrame([as_dict(r) for r in round_trip(nation).collect()], nation.schema)


@query("small_integers", "SELECT o_orderkey AS id, (o_orderkey % 100)::INTEGER AS tiny, (o_orderkey % 30000)::INTEGER AS small, o_orderkey * 100000 AS wide FROM orders")
def small_integers(spark, d):
    """Narrow columns are carried by the next wider type of the format."""
    narrow = lambda n, kind: (F.col("o_orderkey") % n).cast(kind)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), narrow(100, "byte").alias("tiny"), narrow(30000, "short").alias("small"), (F.col("o_orderkey") * 100000).alias("wide"))
    return round_trip(rows)


@query("value_files_nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def value_files_nation(spark, d):
    """One encoded value in each file, read by Spark's file reader."""
    path = _path(spark)
    for r in table(spark, d, "nation").collect():
        write_value(f"{path}/{r['n_nationkey']:03d}.value", as_dict(r), _NATION)
    return read_value_files(spark, path, _NATION).select("value.*")


@query("value_file_region", "SELECT r_regionkey, r_name FROM region")
def value_file_region(spark, d):
    """A whole table as one value in one file, its schema in another, read back on the driver."""
    region, path = table(spark, d, "region"), _path(spark)
    record = S.from_spark(region.schema, "region")
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/schema") as file:
        file.write(S.render(S.Array(record)).encode())
    write_value(f"{path}/value", [as_dict(r) for r in region.collect()], f"{path}/schema")
    return spark.createDataFrame(read_value(f"{path}/value", f"{path}/schema"), region.schema)


@query("container_values_orders", "SELECT * FROM orders")
def container_values_orders(spark, d):
    orders = table(spark, d, "orders")
    return from_container_column(to_container_column(orders, "deflate"), "container", S.render(S.from_spark(orders.schema)))


@query("binary_files_orders", "SELECT * FROM orders")
def binary_files_orders(spark, d):
    orders = table(spark, d, "orders")
    return read_binary_files(spark, write_container(orders, _path(spark), "zstandard"), S.render(S.from_spark(orders.schema)))


@query(
    "agg_over_container",
    "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority",
)
def agg_over_container(spark, d):
    return round_trip(table(spark, d, "orders"), ["o_orderpriority", "o_totalprice"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_JSON_TYPES = {"INTEGER": '"int"', "BIGINT": '"long"', "DOUBLE": '"double"', "VARCHAR": '"string"', "TIMESTAMP": '{"type":"long","logicalType":"local-timestamp-micros"}', "FLOAT[]": '{"type":"array","items":["null","float"]}'}


@query(
    "schema_json",
    "SELECT table_name AS name, '{\"type\":\"record\",\"name\":\"' || table_name || '\",\"fields\":[' || string_agg('{\"name\":\"' || column_name || '\",\"type\":[\"null\",' || CASE data_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _JSON_TYPES.items())
    + f" END || ']}}', ',' ORDER BY ordinal_position) || ']}}' AS schema FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in TABLES)}) GROUP BY table_name",
)
def schema_json(spark, d):
    rows = [(n, S.render(S.from_spark(table(spark, d, n).schema, n))) for n in TABLES]
    return spark.createDataFrame(rows, "name string, schema string")


@query(
    "ragged_union",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer"
    " UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier UNION ALL SELECT n_nationkey, NULL, NULL, n_name FROM nation",
)
def ragged_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return round_trip(union_ragged(a, b, c))


# -- schemas of Python types, damaged bytes -----------------------------------------------------


class Status(enum.Enum):
    F = 1
    O = 2  # noqa: E741
    P = 3


@dataclasses.dataclass
class Money:
    """A type of the user's that is carried by another: cents."""

    cents: int


@dataclasses.dataclass
class Order:
    key: int
    status: Status
    price: Money
    day: datetime.date
    pair: tuple[int, str]
    rest: int | None


lowers(Money, int, lambda m: m.cents, Money)


def duck_varint(x: str) -> str:
    """SQL for the hex of a number's zigzag varint."""
    z = f"(CASE WHEN ({x}) >= 0 THEN 2 * ({x})::HUGEINT ELSE -2 * ({x})::HUGEINT - 1 END)"
    n = f"greatest(1, ceil(length(ltrim(bin({z}), '0')) / 7.0))::INTEGER"
    return f"array_to_string(list_transform(range({n}), lambda i: lpad(hex((({z} >> (7 * i)::INTEGER) & 127) | (CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END)), 2, '0')), '')"


def duck_text(x: str) -> str:
    return f"{duck_varint(f'strlen({x})')} || hex({x})"


# -- encodings as hex ---------------------------------------------------------------------------


_PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey - 20000 END"
_TS = "epoch_us(o_orderdate)"
_ENUM = '{"type":"enum","name":"status","symbols":["F","O","P"]}'
_NATION = '{"type":"record","name":"nation","fields":[{"name":"n_nationkey","type":"int"},{"name":"n_name","type":"string"},{"name":"n_regionkey","type":"int"}]}'


def _price() -> Column:
    return F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") - 20000)


def _local(kind: str) -> str:
    return f'{{"type":"long","logicalType":"{kind}"}}'


#: name: (table, key, Spark value, schema, SQL for the hex)
ENCODINGS: dict[str, tuple[str, str, Callable[[], Column], str, str]] = {
    "long": ("orders", "o_orderkey", lambda: F.col("o_custkey") * -1000003 + F.col("o_orderkey") * 7919, "long", duck_varint("o_custkey * -1000003 + o_orderkey * 7919")),
    "int": ("orders", "o_orderkey", lambda: (F.col("o_orderkey") % 1000 - 500).cast("int"), "int", duck_varint("o_orderkey % 1000 - 500")),
    "bool": ("orders", "o_orderkey", lambda: F.col("o_orderkey") % 3 == 0, "boolean", "CASE WHEN o_orderkey % 3 = 0 THEN '01' ELSE '00' END"),
    "string": ("documents", "doc_id", lambda: F.col("text"), "string", duck_text("text")),
    "bytes": ("customer", "c_custkey", lambda: F.encode("c_name", "UTF-8"), "bytes", duck_text("c_name")),
    "fixed": ("orders", "o_orderkey", lambda: F.encode(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "UTF-8"), '{"type":"fixed","name":"key","size":12}', "hex(lpad(o_orderkey::VARCHAR, 12, '0'))"),
    "enum": ("orders", "o_orderkey", lambda: F.col("o_orderstatus"), _ENUM, duck_varint("list_position(['F', 'O', 'P'], o_orderstatus) - 1")),
    "nullable": ("orders", "o_orderkey", _price, '["null","long"]', f"CASE WHEN o_orderkey % 7 = 0 THEN '00' ELSE '02' || {duck_varint('o_orderkey - 20000')} END"),
    "null_last": ("orders", "o_orderkey", _price, '["long","null"]', f"CASE WHEN o_orderkey % 7 = 0 THEN '02' ELSE '00' || {duck_varint('o_orderkey - 20000')} END"),
    "record": (
        "nation",
        "n_nationkey",
        lambda: F.struct("n_nationkey", "n_name", "n_regionkey"),
        _NATION,
        f"{duck_varint('n_nationkey')} || {duck_text('n_name')} || {duck_varint('n_regionkey')}",
    ),
    "date": ("orders", "o_orderkey", lambda: F.col("o_orderdate").cast("date"), '{"type":"int","logicalType":"date"}', duck_varint("o_orderdate::DATE - DATE '1970-01-01'")),
    "ts_micros": ("orders", "o_orderkey", lambda: F.col("o_orderdate"), _local("local-timestamp-micros"), duck_varint(_TS)),
    "ts_millis": ("orders", "o_orderkey", lambda: F.col("o_orderdate"), _local("local-timestamp-millis"), duck_varint("epoch_ms(o_orderdate)")),
    "instant_micros": ("orders", "o_orderkey", lambda: F.timestamp_seconds("o_orderkey"), _local("timestamp-micros"), duck_varint("o_orderkey * 1000000")),
    "instant_millis": ("orders", "o_orderkey", lambda: F.timestamp_seconds("o_orderkey"), _local("timestamp-millis"), duck_varint("o_orderkey * 1000")),
    "time_micros": ("orders", "o_orderkey", lambda: F.expr("make_time(o_orderkey % 24, o_orderkey % 60, cast(o_orderkey % 59 as decimal(16, 6)))"), _local("time-micros"), duck_varint("((o_orderkey % 24 * 60 + o_orderkey % 60) * 60 + o_orderkey % 59) * 1000000")),
    "array": (
        "orders",
        "o_orderkey",
        lambda: F.array("o_orderkey", "o_custkey"),
        '{"type":"array","items":"long"}',
        f"(SELECT '03' || {duck_varint('length(x) // 2')} || x || '00' FROM (SELECT {duck_varint('o_orderkey')} || {duck_varint('o_custkey')} AS x))",
    ),
    "map": (
        "orders",
        "o_orderkey",
        lambda: F.create_map("o_orderstatus", F.col("o_custkey")),
        '{"type":"map","values":"long"}',
        f"(SELECT '01' || {duck_varint('length(x) // 2')} || x || '00' FROM (SELECT {duck_text('o_orderstatus')} || {duck_varint('o_custkey')} AS x))",
    ),
    "uuid": (
        "orders",
        "o_orderkey",
        lambda: F.regexp_replace(F.md5(F.col("o_orderkey").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        '{"type":"string","logicalType":"uuid"}',
        "'48' || hex(regexp_replace(md5(o_orderkey::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'))",
    ),
}

@query(
    "derived_record_hex",
    f"SELECT o_orderkey AS id, {duck_varint('o_orderkey')} || {duck_varint("list_position(['F', 'O', 'P'], o_orderstatus) - 1")} || {duck_varint('o_custkey * 7')} || {duck_varint("o_orderdate::DATE - DATE '1970-01-01'")}"
    f" || {duck_varint('o_orderkey % 5')} || {duck_text('o_orderpriority')} || CASE WHEN o_orderkey % 7 = 0 THEN '00' ELSE '02' || {duck_varint('o_orderkey - 20000')} END AS hex FROM orders",
)
def derived_record_hex(spark, d):
    """Encoded under the schema of a dataclass that holds an enum, a lowered type, a tuple and an option."""
    value = F.struct(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_custkey") * 7).alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.struct((F.col("o_orderkey") % 5).alias("_1"), F.col("o_orderpriority").alias("_2")).alias("pair"),
        _price().alias("rest"),
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.hex(to_binary(value, schema_of(Order))).alias("hex"))


@query(
    "host_values_orders",
    "SELECT o_orderkey AS key, o_orderstatus AS status, o_custkey * 7 AS cents, o_orderdate::DATE::VARCHAR AS day, o_orderpriority AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey - 20000 END AS rest FROM orders WHERE o_orderkey <= 200",
)
def host_values_orders(spark, d):
    """Values of the user's types, encoded and decoded to the same types on the driver."""
    rows = table(spark, d, "orders").filter("o_orderkey <= 200").withColumn("rest", _price()).collect()
    orders = [Order(r["o_orderkey"], Status[r["o_orderstatus"]], Money(r["o_custkey"] * 7), r["o_orderdate"].date(), (1, r["o_orderpriority"]), r["rest"]) for r in rows]
    back = [decode_as(Order, encode(schema_of(Order), x)) for x in orders]
    return spark.createDataFrame(
        [(x.key, x.status.name, x.price.cents, x.day.isoformat(), x.pair[1], x.rest) for x in back],
        "key long, status string, cents long, day string, priority string, rest long",
    )


#: name: (schema, value, its damage, SQL for what a permissive reader gives)
DAMAGES = {
    "cut_number": ("long", lambda: F.col("o_orderkey") * 100000, lambda b: F.when(F.col("o_orderkey") % 3 == 0, F.substring(b, F.lit(1), F.octet_length(b) - 1)).otherwise(b), "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 100000 END"),
    "cut_string": ("string", lambda: F.col("o_orderpriority"), lambda b: F.when(F.col("o_orderkey") % 3 == 0, F.substring(b, F.lit(1), F.octet_length(b) - 1)).otherwise(b), "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END"),
    "enum_symbol": ('{"type":"enum","name":"status","symbols":["F","O","P"]}', lambda: F.col("o_orderstatus"), lambda b: F.when(F.col("o_orderkey") % 3 == 0, F.lit(b"\x06")).otherwise(b), "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END"),
    "union_branch": ('["null","long"]', lambda: F.col("o_orderkey"), lambda b: F.when(F.col("o_orderkey") % 3 == 0, F.lit(b"\x04\x02")).otherwise(b), "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END"),
    "array_size": ('{"type":"array","items":"long"}', lambda: F.array("o_orderkey"), lambda b: F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(b"\x01\x7e"), F.substring(b, F.lit(3), F.lit(100)))).otherwise(b), "CASE WHEN o_orderkey % 3 <> 0 THEN [o_orderkey] END"),
}

for _name, (_schema, _value, _damage, _sql) in DAMAGES.items():

    def _damaged(spark, d, schema=_schema, value=_value, damage=_damage):
        rows = table(spark, d, "orders").withColumn("_b", to_binary(value(), schema))
        return rows.select(F.col("o_orderkey").alias("id"), from_binary(damage(F.col("_b")), schema, permissive=True).alias("value"))

    query(f"damaged_{_name}", f"SELECT o_orderkey AS id, {_sql} AS value FROM orders")(_damaged)

for _name, (_table, _key, _value, _schema, _sql) in ENCODINGS.items():

    def _encoding(spark, d, t=_table, key=_key, value=_value, schema=_schema):
        return table(spark, d, t).select(F.col(key).alias("id"), F.hex(to_binary(value(), schema)).alias("hex"))

    def _arrow(spark, d, t=_table, key=_key, value=_value, schema=_schema):
        return table(spark, d, t).select(F.col(key).alias("id"), F.hex(to_binary(value(), schema, native=False)).alias("hex"))

    def _size(spark, d, t=_table, key=_key, value=_value, schema=_schema):
        return table(spark, d, t).select(F.col(key).alias("id"), encoded_size(value(), schema).cast("int").alias("size"))

    query(f"encode_{_name}_hex", f"SELECT {_key} AS id, {_sql} AS hex FROM {_table}")(_encoding)
    query(f"encode_arrow_{_name}_hex", f"SELECT {_key} AS id, {_sql} AS hex FROM {_table}")(_arrow)
    query(f"encoded_size_{_name}", f"SELECT {_key} AS id, (length({_sql}) // 2)::INTEGER AS size FROM {_table}")(_size)


# -- round trips --------------------------------------------------------------------------------

_same: Callable[[Column], Column] = lambda v: v


def _micros_of_day(v: Column) -> Column:
    return F.time_diff(F.lit("microsecond"), F.make_time(F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")), v)


_ROW = {
    "type": "record",
    "name": "inner",
    "fields": [
        {"name": "key", "type": "long"},
        {"name": "tags", "type": {"type": "array", "items": ["null", "string"]}},
        {"name": "when", "type": ["null", {"type": "int", "logicalType": "date"}]},
        {"name": "prices", "type": {"type": "map", "values": "double"}},
    ],
}


# A duration's fields hold 31 bits: of o_orderkey seconds, whole days are carried by its days (in steps of 31, where the days have a count of their own).


def _whole_days() -> Column:
    return F.floor(F.col("o_orderkey") / 86_400).cast("long")


def _millis_of_day() -> Column:
    return (F.col("o_orderkey") % 86_400 * 1000).cast("int")


def _json(node: object) -> str:
    import json

    return json.dumps(node)


#: name: (table, key, Spark value, schema, what is shown of the decoded value, SQL for that)
ROUND_TRIPS: dict[str, tuple[str, str, Callable[[], Column], str, Callable[[Column], Column], str]] = {
    "null": ("nation", "n_nationkey", lambda: F.lit(None), "null", lambda v: v.isNull(), "true"),
    "boolean": ("orders", "o_orderkey", lambda: F.col("o_orderkey") % 2 == 0, "boolean", _same, "o_orderkey % 2 = 0"),
    "int": ("nation", "n_nationkey", lambda: F.col("n_regionkey"), "int", _same, "n_regionkey"),
    "long": ("orders", "o_orderkey", lambda: F.col("o_custkey"), "long", _same, "o_custkey"),
    "float": ("orders", "o_orderkey", lambda: F.col("o_totalprice").cast("float"), "float", _same, "o_totalprice::FLOAT"),
    "double": ("orders", "o_orderkey", lambda: F.col("o_totalprice"), "double", _same, "o_totalprice"),
    "bytes": ("customer", "c_custkey", lambda: F.encode("c_name", "UTF-8"), "bytes", F.hex, "hex(c_name)"),
    "string": ("documents", "doc_id", lambda: F.col("text"), "string", _same, "text"),
    "fixed": ("orders", "o_orderkey", lambda: F.unhex(F.md5(F.col("o_orderkey").cast("string"))), '{"type":"fixed","name":"digest","size":16}', lambda v: F.lower(F.hex(v)), "md5(o_orderkey::VARCHAR)"),
    "enum": ("orders", "o_orderkey", lambda: F.col("o_orderstatus"), _ENUM, _same, "o_orderstatus"),
    "nullable": ("orders", "o_orderkey", _price, '["null","long"]', _same, _PRICE),
    "record": (
        "orders",
        "o_orderkey",
        lambda: F.struct(F.col("o_orderkey").cast("long").alias("key"), F.col("o_orderpriority").alias("priority"), _price().cast("long").alias("rest"), F.col("o_orderdate").cast("date").alias("day")),
        _json({"type": "record", "name": "order", "fields": [{"name": "key", "type": "long"}, {"name": "priority", "type": "string"}, {"name": "rest", "type": ["long", "null"]}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}]}),
        lambda v: F.concat_ws("|", v["key"], v["priority"], F.coalesce(v["rest"].cast("string"), F.lit("-")), v["day"]),
        "concat_ws('|', o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE (o_orderkey - 20000)::VARCHAR END, o_orderdate::DATE)",
    ),
    "array": ("embeddings", "vec_id", lambda: F.col("embedding"), '{"type":"array","items":"float"}', lambda v: element(v, 3), "embedding[3]"),
    "array_size": ("embeddings", "vec_id", lambda: F.col("embedding"), '{"type":"array","items":"float"}', F.size, "len(embedding)::INTEGER"),
    "map": ("orders", "o_orderkey", lambda: F.create_map(F.col("o_orderstatus"), F.col("o_custkey")), '{"type":"map","values":"long"}', lambda v: v[F.col("o_orderstatus")], "o_custkey"),
    "decimal": ("orders", "o_orderkey", lambda: (F.col("o_totalprice") - 150000).cast("decimal(18,2)"), '{"type":"bytes","logicalType":"decimal","precision":18,"scale":2}', lambda v: v.cast("string"), "(o_totalprice - 150000)::DECIMAL(18, 2)::VARCHAR"),
    "decimal_fixed": ("orders", "o_orderkey", lambda: (F.col("o_orderkey") * -7).cast("decimal(30,4)"), '{"type":"fixed","name":"d","size":16,"logicalType":"decimal","precision":30,"scale":4}', lambda v: v.cast("long"), "o_orderkey * -7"),
    "uuid": ("orders", "o_orderkey", ENCODINGS["uuid"][2], '{"type":"string","logicalType":"uuid"}', _same, "regexp_replace(md5(o_orderkey::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"),
    "date": ("orders", "o_orderkey", lambda: F.col("o_orderdate").cast("date"), '{"type":"int","logicalType":"date"}', lambda v: v.cast("string"), "o_orderdate::DATE::VARCHAR"),
    "time_millis": ("orders", "o_orderkey", ENCODINGS["time_micros"][2], '{"type":"int","logicalType":"time-millis"}', _micros_of_day, "((o_orderkey % 24 * 60 + o_orderkey % 60) * 60 + o_orderkey % 59) * 1000000"),
    "time_micros": ("orders", "o_orderkey", ENCODINGS["time_micros"][2], _local("time-micros"), _micros_of_day, "((o_orderkey % 24 * 60 + o_orderkey % 60) * 60 + o_orderkey % 59) * 1000000"),
    "timestamp_millis": ("orders", "o_orderkey", lambda: F.timestamp_millis("o_orderkey"), _local("timestamp-millis"), F.unix_millis, "o_orderkey"),
    "timestamp_micros": ("orders", "o_orderkey", lambda: F.timestamp_micros(F.col("o_orderkey") * 1001), _local("timestamp-micros"), F.unix_micros, "o_orderkey * 1001"),
    "local_timestamp_millis": ("events", "event_id", lambda: F.date_trunc("second", "ts").cast("timestamp_ntz"), _local("local-timestamp-millis"), _same, "date_trunc('second', ts)"),
    "local_timestamp_micros": ("events", "event_id", lambda: F.col("ts"), _local("local-timestamp-micros"), _same, "ts"),
    "duration": (
        "orders",
        "o_orderkey",
        lambda: F.struct((F.col("o_orderkey") % 12).cast("int").alias("months"), (F.col("o_orderkey") % 31 + 31 * _whole_days()).cast("int").alias("days"), _millis_of_day().alias("millis")),
        '{"type":"fixed","name":"duration","size":12,"logicalType":"duration"}',
        lambda v: v["months"].cast("long") * 10**12 + (v["days"] % 31).cast("long") * 10**10 + F.floor(v["days"] / 31).cast("long") * 86_400_000 + v["millis"].cast("long"),
        "o_orderkey % 12 * 1000000000000 + o_orderkey % 31 * 10000000000 + o_orderkey * 1000",
    ),
    "duration_interval": (
        "orders",
        "o_orderkey",
        lambda: F.struct(F.lit(1).alias("months"), (2 + _whole_days()).cast("int").alias("days"), _millis_of_day().alias("millis")),
        '{"type":"fixed","name":"duration","size":12,"logicalType":"duration"}',
        lambda v: F.date_format(F.lit("2020-01-31 00:00:00").cast("timestamp_ntz") + duration_interval(v), "yyyy-MM-dd"),
        "strftime(TIMESTAMP '2020-02-29' + INTERVAL 2 DAY + to_seconds(o_orderkey), '%Y-%m-%d')",
    ),
    "union_member": (
        "orders",
        "o_orderkey",
        lambda: F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("member0"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority")).alias("member1")),
        '["long","string"]',
        lambda v: F.coalesce(v["member0"].cast("string"), v["member1"]),
        "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE o_orderpriority END",
    ),
    "union_long": ("orders", "o_orderkey", lambda: F.col("o_orderkey") * 1000003, '["int","null","long"]', _same, "o_orderkey * 1000003"),
    "nested": (
        "orders",
        "o_orderkey",
        lambda: F.struct(
            F.col("o_orderkey").alias("key"),
            F.array(F.col("o_orderstatus"), F.lit(None).cast("string")).alias("tags"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("when"),
            F.create_map(F.lit("total"), F.col("o_totalprice")).alias("prices"),
        ),
        _json(_ROW),
        lambda v: F.concat_ws("|", v["key"], v["tags"][0], F.size(v["tags"]), F.coalesce(v["when"].cast("string"), F.lit("-")), F.floor(v["prices"]["total"])),
        "concat_ws('|', o_orderkey, o_orderstatus, 2, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE o_orderdate::DATE::VARCHAR END, floor(o_totalprice)::BIGINT)",
    ),
}

for _name, (_table, _key, _value, _schema, _shown, _sql) in ROUND_TRIPS.items():

    def _trip(spark, d, t=_table, key=_key, value=_value, schema=_schema, shown=_shown):
        rows = table(spark, d, t).withColumn("_value", from_binary(to_binary(value(), schema), schema))
        return rows.select(F.col(key).alias("id"), shown(F.col("_value")).alias("value"))

    def _native_trip(spark, d, t=_table, key=_key, value=_value, schema=_schema, shown=_shown):
        rows = table(spark, d, t).withColumn("_value", from_binary(to_binary(value(), schema), schema, native=True))
        return rows.select(F.col(key).alias("id"), shown(F.col("_value")).alias("value"))

    query(f"roundtrip_{_name}", f"SELECT {_key} AS id, {_sql} AS value FROM {_table}")(_trip)
    if native_reader(S.parse(_schema)) is not None:
        query(f"decode_native_{_name}", f"SELECT {_key} AS id, {_sql} AS value FROM {_table}")(_native_trip)


@query(
    "container_logical_types",
    "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, o_totalprice::DECIMAL(15, 2)::VARCHAR AS price, o_orderkey * 1000 AS instant, [o_orderkey, o_custkey][2] AS second FROM orders",
)
def container_logical_types(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("price"),
        F.timestamp_millis(F.col("o_orderkey") * 1000).alias("at"),
        F.array("o_orderkey", "o_custkey").alias("keys"),
    )
    back = round_trip(rows, compression="deflate")
    return back.select("o_orderkey", F.col("day").cast("string").alias("day"), F.col("price").cast("string").alias("price"), F.unix_millis("at").alias("instant"), element(F.col("keys"), 2).alias("second"))


