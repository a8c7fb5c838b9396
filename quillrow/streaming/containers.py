"""Containers that arrive in a folder, as a stream.

Spark's own file stream lists new files and keeps its place in the checkpoint; each micro-batch
decodes the new files' rows. The format has no stream semantics of its own, so everything
past the rows (watermarks, windows, state) is Structured Streaming as usual.

By default a file's bytes come through Spark as one value, from any store that Spark reaches, which holds
less than 2 GB. With ``split_bytes`` the tasks read byte ranges themselves, through Arrow's file systems, so that
files may have any size and a large one occupies many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.container import filesystem
from quillrow.operators.table import from_container_column, write_container
from quillrow.schema import parse, to_spark
from quillrow.session import install
from quillrow.sources.container_source import record_batches

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_container_stream(spark: SparkSession, path: str, schema_json: str, max_files_per_trigger: int = 64, split_bytes: int | None = None) -> DataFrame:
    """Rows of the containers that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    if split_bytes is None:
        return from_container_column(files.select("content"), "content", schema_json)
    install(spark)
    record = parse(schema_json)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.filter("length > 0").select("path", starts.alias("start")).repartition("path", "start")
    return ranges.mapInArrow(_ranges([f.name for f in record.fields], split_bytes), to_spark(record))


def _ranges(names: list[str], split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in ("path", "start")), strict=True):
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as file:
                    yield from record_batches(file, path, names, None, start, start + split_bytes)

    return run


def write_container_batch(path: str, compression: str = "null"):
    """For foreachBatch: each micro-batch becomes a folder of its own, replaced when the batch is retried."""
    return lambda df, batch: write_container(df, f"{path}/batch-{batch:010d}", compression, mode="overwrite")
