"""What the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrow.runtime import checkpoint, gathered, materialize, shared_dir, ship, sweep  # noqa: F401  (re-exported)

#: ASCII white space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order, by JVM functions alone."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: DuckDB SQL for a text with its letters A-Z in lower case, for its words, and for the CRC-32 of ASCII text, bit by bit.
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SQL_CRC32 = (
    "(CASE WHEN {0} = '' THEN 0 ELSE xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),"
    " lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) END)"
)


def named(i: str | Column) -> Column:
    """An id as a key that is never null, so that a join deals rows out by it once, for a window or a grouping too."""
    return F.xxhash64(F.isnull(i), i)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row: an order in which only rows that repeat tie, so that reruns choose alike."""

    def has_map(kind: T.DataType) -> bool:
        inner = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
        return isinstance(kind, T.MapType | T.VariantType) or any(map(has_map, inner))

    column = lambda f: F.col(f"`{f.name}`")
    return F.xxhash64(*(F.to_json(F.struct(column(f))) if has_map(f.dataType) else column(f) for f in df.schema))


def kept_by_worker(make, text: str):
    """``make(text)``, which a Python worker keeps for its later tasks; of each maker the last one."""
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if store.get(make.__name__, ("", None))[0] != text:
        store[make.__name__] = text, make(text)
    return store[make.__name__][1]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at once; memory that a batch took is given back.

    What the worker keeps from tasks of another kind is given back too.
    """
    sys.modules.pop("_kept_by_worker", None)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
        trim()


def trim() -> None:
    """Gives memory that Python has freed back to the system, where the C library can do so."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
