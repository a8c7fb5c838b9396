"""Containers as tables: scans, sinks, counts, single rows, and tables of ragged rows."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrow import container
from quillrow.errors import ContainerError, SchemaError
from quillrow.runtime import scratch
from quillrow.schema import Record, from_spark, parse, to_spark
from quillrow.session import install
from quillrow.sources.container_source import FORMAT, SPLIT_BYTES, record_batches, write_batches

#: A split is not made smaller than this.
LEAST_SPLIT = 1 << 20


def read_container(spark: SparkSession, path: str, columns: list[str | int] | None = None, **options: object) -> DataFrame:
    """A container file, a folder of them or a pattern. columns (names or places): the decoder skips the others."""
    install(spark)
    if "splitBytes" not in options:  # small tables too are read by all cores
        share = sum(size for _, size in container.list_files(path)) // max(1, spark.sparkContext.defaultParallelism)
        options["splitBytes"] = min(SPLIT_BYTES, max(LEAST_SPLIT, share))
    reader = spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()})
    whole = reader.load(path)
    if columns is not None:
        names = [whole.columns[c] if isinstance(c, int) else c for c in columns]
        whole = reader.schema(T.StructType([whole.schema[n] for n in names])).load(path)
    if str(options.get("counts", "")).lower() == "true":
        return whole
    # Spark drops the metadata of a Python source's fields; it says what their types cannot.
    kept = {f.name: f.metadata for f in to_spark(container_schema(path))}
    return whole.select(*(F.col(f"`{n}`").alias(n, metadata=kept[n]) if n in kept else F.col(f"`{n}`") for n in whole.columns))


def container_schema(path: str) -> Record:
    """The rows' schema in the header of the first file at a path."""
    files = container.list_files(path)
    if not files:
        raise ContainerError(f"{path} has no file to take a schema from")
    fs, _ = container.filesystem(path)
    with fs.open_input_file(files[0][0]) as file:
        return container.read_header(file).record


def _wide(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ByteType | T.ShortType):
        return T.IntegerType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_wide(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _wide(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _wide(f.dataType), f.nullable, f.metadata) for f in kind])
    return kind


def widened(df: DataFrame) -> DataFrame:
    """df with its one- and two-byte integers as int, the narrowest that the format has."""
    wide = [(f, _wide(f.dataType)) for f in df.schema]
    if all(f.dataType == kind for f, kind in wide):
        return df
    return df.select(*(F.col(f"`{f.name}`") if f.dataType == kind else F.col(f"`{f.name}`").cast(kind).alias(f.name, metadata=f.metadata) for f, kind in wide))


def write_container(df: DataFrame, path: str, compression: str = "null", mode: str = "append", schema_json: str | None = None, **options: object) -> str:
    """Writes a file for each partition; the path is returned."""
    install(df.sparkSession)
    df = widened(df)
    container.codec_name(compression)
    if schema_json:
        options["schemaJson"] = schema_json
    df.write.format(FORMAT).options(compression=compression, **{k: str(v) for k, v in options.items()}).mode(mode).save(path)
    return path


def container_writer(path: str, **options: object) -> Callable[[DataFrame], str]:
    """A sink to pipe a table into: ``container_writer(path)(df)``."""
    return lambda df: write_container(df, path, **options)


def round_trip(df: DataFrame, columns: list[str] | None = None, compression: str = "null", **options: object) -> DataFrame:
    """df written as a container into the shared folder, and the container read."""
    path = scratch(df.sparkSession, "container")
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # encoding costs more than dealing the rows out
        df = df.repartition(cores)
    return read_container(df.sparkSession, write_container(df, path, compression, **options), columns)


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _rows) of each block, from the block headers alone."""
    return read_container(spark, path, counts="true")


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """One row, n: the number of rows, without decoding any."""
    return block_index(spark, path).agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"))


def row_at(spark: SparkSession, path: str, index: int) -> DataFrame:
    """The row at a place (from 0) in the order of files, blocks and rows. Block headers are counted, and one block is decoded."""
    if index < 0:
        raise IndexError(index)
    for r in block_index(spark, path).groupBy("_file").agg(F.sum("_rows").alias("n")).orderBy("_file").toLocalIterator():
        if index < r["n"]:
            name = r["_file"]
            break
        index -= r["n"]
    else:
        raise IndexError("the table has fewer rows")
    for r in read_container(spark, path, counts="true", file=name).orderBy("_block").toLocalIterator():
        if index < r["_rows"]:
            break
        index -= r["_rows"]
    found = read_container(spark, path, positions="true", file=name, block=r["_block"]).filter(F.col("_row") == index)
    return found.drop("_file", "_block", "_row")


def element(x: Column, place: int) -> Column:
    """An array's element, counted from 1; null beyond its end."""
    return F.try_element_at(x, F.lit(place))


def as_dict(row: Row) -> dict:
    return row.asDict(recursive=True)


# -- containers as values -----------------------------------------------------------------------


def _decoded(names: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(column).to_pylist():
                if data is not None:
                    yield from record_batches(io.BytesIO(data), "a value", names, None)

    return run


def from_container_column(df: DataFrame, column: str, schema_json: str) -> DataFrame:
    """The rows of the containers in a binary column."""
    install(df.sparkSession)
    record = parse(schema_json)
    return df.select(column).mapInArrow(_decoded([f.name for f in record.fields], column), to_spark(record))


def read_binary_files(spark: SparkSession, path: str, schema_json: str) -> DataFrame:
    """Containers through Spark's own file reader: any store that Spark reaches, one task for each file."""
    return from_container_column(spark.read.format("binaryFile").load(path).select("content"), "content", schema_json)


def _encoded(record: Record, codec: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        writer = container.Writer(out, record, codec, block_bytes)
        write_batches(writer, record, batches)
        if writer.rows:
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary()), pa.array([writer.rows], pa.int64())], ["container", "rows"])

    return run


def to_container_column(df: DataFrame, compression: str = "null", schema_json: str | None = None, block_bytes: int = 1 << 18) -> DataFrame:
    """(container, rows): each partition as one container in a binary value."""
    install(df.sparkSession)
    record = parse(schema_json) if schema_json else from_spark(df.schema)
    return df.mapInArrow(_encoded(record, container.codec_name(compression), block_bytes), "container binary, rows long")


# -- ragged rows --------------------------------------------------------------------------------


def union_ragged(*frames: DataFrame) -> DataFrame:
    """Rows of tables with differing columns: all columns, null where a table lacks one, mixed numbers widened."""
    out = frames[0].select("*")
    for f in frames[1:]:
        out = out.unionByName(f.select("*"), allowMissingColumns=True)
    return out


def _value_type(x: object) -> T.DataType:
    from quillrow.derive import spark_type_of

    return spark_type_of(x)


def from_ragged_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """A table of untyped rows: every field that occurs, null where absent, the widest of mixed numbers."""
    rows, found = list(rows), {}
    for row in rows:
        for name, value in row.items():
            kind = found.setdefault(name, T.NullType())
            if value is not None:
                found[name] = _widest(name, kind, _value_type(value))
    as_is = lambda kind, v: float(v) if isinstance(kind, T.DoubleType) and v is not None else v
    schema = T.StructType([T.StructField(n, k, True) for n, k in found.items()])
    return spark.createDataFrame([tuple(as_is(k, r.get(n)) for n, k in found.items()) for r in rows], schema)


def _widest(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.NullType) or a == b:
        return b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    raise SchemaError(f"field {name} is {a.simpleString()} and {b.simpleString()}")


def read_rows(data: bytes) -> list[dict]:
    """The rows of a container in memory, on the driver."""
    return container.read_bytes(data)[1]


