"""The Spark data source of container files: ``spark.read.format("row_container").load(path)``.

Reading splits files by byte range on the driver without opening them, but for one header that
gives the schema. A user schema of fewer fields makes the decoder skip the others. Options:
``splitBytes``, ``schemaJson`` (for reading files of a folder that holds none yet), ``positions``
(true adds _file, _block and _row), ``counts`` (true reads block headers only: _file, _block and
_rows), ``file`` and ``block`` (one file of the path, as _file names it, and the block at one
position in it). Writing makes a file for each task: ``compression`` (null, deflate, bzip2, xz, zstandard),
``blockBytes``, ``schemaJson``, ``recordName``. Files become visible when the job commits.
"""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillrow import columns, container, wire
from quillrow.arrow import arrow_type, to_array, to_values
from quillrow.errors import ContainerError, SchemaError
from quillrow.schema import Record, from_spark, parse, render, spark_type, to_spark

FORMAT = "row_container"
log = logging.getLogger("quillrow")
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 256 << 10
#: Files that a commit moves at a time.
MOVES = 64
POSITIONS = (T.StructField("_file", T.StringType(), False), T.StructField("_block", T.LongType(), False), T.StructField("_row", T.LongType(), False))
COUNTS = T.StructType([*POSITIONS[:2], T.StructField("_rows", T.LongType(), False)])


def _true(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def record_batches(file, path: str, wanted: list[str], expected: Record | None, start: int = 0, end: int | None = None, positions: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of a byte range, a batch for each block, with the wanted fields."""
    header = container.read_header(file)
    record = header.record
    own = {f.name: f.type for f in record.fields}
    names = [n for n in wanted if n not in {p.name for p in POSITIONS}] if positions else wanted
    for n in names:
        if n not in own:
            raise ContainerError(f"{path} has no field {n}")
        if expected is not None and arrow_type(own[n]) != arrow_type(next(f.type for f in expected.fields if f.name == n)):
            raise ContainerError(f"{path}: field {n} is not of the type that was read from the first file")
    read = wire.columns_decoder(record, names)
    for b in container.blocks(file, header, start, end):
        plain = container.decompress(header.codec, b.data)
        try:
            found, _ = read(plain, 0, len(plain), b.rows)
        except ContainerError:
            raise
        except ValueError as error:
            raise ContainerError(f"{path}: the block at {b.offset} is damaged: {error}") from None
        arrays = {n: to_array(c, own[n]) for n, c in zip(names, found, strict=True)}
        if positions:
            arrays |= {"_file": pa.array([path] * b.rows), "_block": pa.array([b.offset] * b.rows, pa.int64()), "_row": pa.array(range(b.rows), pa.int64())}
        if wanted:
            yield pa.RecordBatch.from_arrays([arrays[n] for n in wanted], wanted)
        elif b.rows:
            yield pa.RecordBatch.from_struct_array(pa.array([{}] * b.rows, pa.struct([])))


def write_batches(writer: container.Writer, record: Record, batches: Iterator[pa.RecordBatch]) -> None:
    """The rows of batches, encoded by columns where that is possible and else row by row."""
    encode, by_columns = wire.rows_encoder(record), columns.supported(record)
    for batch in batches:
        found = columns.rows_of(record, batch.columns, batch.num_rows) if by_columns else None
        if found is None:
            writer.add(encode([to_values(c) for c in batch.columns], batch.num_rows))
        else:
            writer.add_encoded(*found)
    writer.end_block()


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict, wanted: list[str], expected: Record | None):
        self.path, self.wanted, self.expected = path, wanted, expected
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.positions, self.counts = _true(options, "positions"), _true(options, "counts")
        self.file, self.block = options.get("file"), options.get("block")

    def partitions(self) -> list[Split]:
        out = []
        for path, size in container.list_files(self.path):
            if self.file not in (None, path):
                continue
            if self.block is not None:  # the range in which the mark before the block begins
                mark = int(self.block) - container.SYNC_SIZE
                out.append(Split(path, mark, mark + 1))
                continue
            out += [Split(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        log.debug("%s: %d splits", self.path, len(out))
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = container.filesystem(self.path)
        with fs.open_input_file(partition.path) as file:
            if self.counts:
                found = list(container.blocks(file, container.read_header(file), partition.start, partition.end, with_data=False))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * n, pa.string()), pa.array([b.offset for b in found], pa.int64()), pa.array([b.rows for b in found], pa.int64())], ["_file", "_block", "_rows"]
                )
            else:
                yield from record_batches(file, partition.path, self.wanted, self.expected, partition.start, partition.end, self.positions)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex
        self.codec = container.codec_name(options.get("compression"))
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.record = parse(options["schemajson"]) if options.get("schemajson") else from_spark(schema, options.get("recordname", "row"))
        if not isinstance(self.record, Record) or [f.name for f in self.record.fields] != list(schema.names):
            raise SchemaError("the schema must be a record with the columns' names in their order")
        for f, column in zip(self.record.fields, schema, strict=True):
            if spark_type(f.type)[0].simpleString() != column.dataType.simpleString():
                raise SchemaError(f"column {column.name} is {column.dataType.simpleString()}, which its schema does not hold")
        fs, root = container.filesystem(path)
        self.earlier = [p for p, _ in container.list_files(path)] if fs.get_file_info(root).type != pafs.FileType.NotFound else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        fs, root = container.filesystem(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}{container.SUFFIX}"
        temporary = f"{root}/_temporary-{self.job}/{task.taskAttemptId()}-{name}"
        fs.create_dir(os.path.dirname(temporary), recursive=True)
        with fs.open_output_stream(temporary) as file:
            writer = container.Writer(file, self.record, self.codec, self.block)
            write_batches(writer, self.record, iterator)
        return _Written(temporary, f"{root}/{name}", writer.rows)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = container.filesystem(self.path)
        fs.create_dir(root, recursive=True)
        # Stores answer slowly and take many requests at once.
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda m: fs.move(m.temporary, m.final), [m for m in messages if m is not None]))
            if self.overwrite:
                list(pool.map(fs.delete_file, self.earlier))
        log.debug("%s: committed %d files, %d rows", self.path, len(messages), sum(m.rows for m in messages if m is not None))
        self._clean()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, root = container.filesystem(self.path)
        try:
            fs.delete_dir(f"{root}/_temporary-{self.job}")
        except OSError:
            pass


class RowContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ContainerError("a path is needed: load(path) or save(path)")
        return self.options["path"]

    def _record(self) -> Record:
        if self.options.get("schemajson"):
            return parse(self.options["schemajson"])
        files = container.list_files(self._path())
        if not files:
            raise ContainerError(f"{self._path()} has no file to take a schema from")
        fs, _ = container.filesystem(self._path())
        with fs.open_input_file(files[0][0]) as file:
            return container.read_header(file).record

    def schema(self) -> T.StructType:
        if _true(self.options, "counts"):
            return COUNTS
        found = to_spark(self._record())
        return T.StructType([*found, *POSITIONS]) if _true(self.options, "positions") else found

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._path(), {k.lower(): v for k, v in self.options.items()}, list(schema.names), None if _true(self.options, "counts") else self._record())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._path(), {k.lower(): v for k, v in self.options.items()}, schema, overwrite)


__all__ = ["FORMAT", "RowContainerSource", "record_batches", "render"]
