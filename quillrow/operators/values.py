"""Single values in files: one encoded value, without a schema beside it, makes up a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow import container, wire
from quillrow.functions.codec import from_binary
from quillrow.schema import Schema, parse_file
from quillrow.session import install


def schema_from(schema: Schema | str) -> Schema:
    """A schema, its JSON text, or the path of a file that holds it."""
    return parse_file(schema) if isinstance(schema, str) else schema


def write_value(path: str, value: object, schema: Schema | str) -> int:
    """Encodes one host value into a file; the bytes written are counted."""
    fs, inner = container.filesystem(path)
    data = wire.encode(schema_from(schema), value)
    fs.create_dir(inner.rpartition("/")[0] or "/", recursive=True)
    with fs.open_output_stream(inner) as file:
        file.write(data)
    return len(data)


def read_value(path: str, schema: Schema | str) -> object:
    """The physical value that a file begins with."""
    fs, inner = container.filesystem(path)
    with fs.open_input_stream(inner) as file:
        return wire.decode(schema_from(schema), file.read())


def read_value_files(spark: SparkSession, path: str, schema: Schema | str, permissive: bool = False) -> DataFrame:
    """(path, value) for each file at a path, through Spark's own file reader."""
    install(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", from_binary(F.col("content"), schema_from(schema), permissive).alias("value"))
