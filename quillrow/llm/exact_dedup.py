"""Exact deduplication by content-defined chunk recipes.

A text, stripped of ASCII white space, is cut where a rolling hash of its last 32 bytes hits a
mask, so equal texts get equal chunks wherever they stand. Chunk contents travel once: they are
grouped by (hash, bytes), which verifies that a hash names one content. After that a document is
its recipe, the ordered list of chunk identifiers, and only recipes are compared. Of a hash that
names several contents, of which even 10^11 chunks have a few hundred, the content itself stands
in the recipe; these hashes are handed to all tasks, up to MOST_COLLIDED of them, and joined beyond.

Recipes and their groups meet in a join of two written tables, whose hot keys (a text with a third
of all rows) Spark splits at run time.

Defined cases: null text counts as empty; all empty texts are equal. Of equal texts the row with
the most code points in the original stays, then the smallest doc_id, null ids last. Rows that
repeat a doc_id and a text are all returned, and one of them is kept. An empty table gives an
empty result. Other columns of the input are ignored by ``exact_groups`` and passed through by
``exact_dedup``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrow.llm.common import checkpoint, named, row_hash, ship, small_batches, table, text_or_empty

#: Bytes that do not count when texts are compared.
DELETED = b" \t\n\v\f\r"
#: Chunk sizes in bytes: a cut needs LEAST behind it, falls on one position in 2**MASK_BITS, and is forced at MOST.
LEAST, MASK_BITS, MOST = 512, 10, 8192
WINDOW = 32
#: Hashes with several contents that tasks get as a list (8 bytes each); beyond, recipes are made by a join.
MOST_COLLIDED = 1_000_000


def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def _cut_points(block: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW bytes allows a cut."""
    h = gear[block]
    step = 1
    while step < WINDOW:  # the window doubles each time
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_ends(texts: list[bytes], gear: np.ndarray | None = None) -> list[list[int]]:
    """For each text the ends of its chunks; the last is its length (0 for an empty one)."""
    gear = _gear() if gear is None else gear
    out: list[list[int]] = []
    at = 0
    while at < len(texts):  # a few MB at a time bound the memory of the hash arrays
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 22):
            size += len(texts[to])
            to += 1
        points = _cut_points(np.frombuffer(b"".join(texts[at:to]), dtype=np.uint8), gear)
        lengths = np.fromiter((len(t) for t in texts[at:to]), dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.searchsorted(points, starts)
        for k in range(to - at):
            n, last, ends = int(lengths[k]), 0, []
            for p in (points[bounds[k] : bounds[k + 1]] - starts[k]).tolist():
                while p - last > MOST:
                    last += MOST
                    ends.append(last)
                if p - last >= LEAST and p < n:
                    ends.append(p)
                    last = p
            while n - last > MOST:
                last += MOST
                ends.append(last)
            ends.append(n)
            out.append(ends)
        at = to
    return out


def _signed(h: int, bits: int) -> int:
    h &= (1 << bits) - 1
    return h - (1 << 64) if h >> 63 else h


def _recipes(hash_bits: int, collided):
    """Recipes; contents: those of the chunks whose hash is in the list, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, several = _gear(), frozenset(collided.value.tolist())
        for batch in small_batches(batches, 1024):
            texts = batch.column("text").to_pylist()
            bare = [t.encode("utf-8", "surrogatepass").translate(None, DELETED) for t in texts]
            recipes, contents = [], []
            for b, ends in zip(bare, chunk_ends(bare, gear), strict=True):
                spans = list(zip([0, *ends], ends))  # noqa: B905
                ids = [_signed(xxhash.xxh3_64_intdigest(b[x:y]), hash_bits) for x, y in spans]
                recipes.append(ids)
                contents.append([b[x:y] for i, (x, y) in zip(ids, spans, strict=True) if i in several] if several else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bare], pa.string()),
                    pa.array(recipes, pa.list_(pa.int64())),
                    pa.array(contents, pa.list_(pa.binary())),
                ],
                ["doc_id", "n_code_points", "text_sha256", "recipe", "contents"],
            )

    return run


def _chunks(hash_bits: int, with_row: bool):
    """Chunk contents; with_row: each with the row it belongs to and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        for batch in small_batches(batches, 1024):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < 1 << 22:
                    size += len(texts[to])
                    to += 1
                bare = [t.encode("utf-8", "surrogatepass").translate(None, DELETED) for t in texts[at:to]]
                row, place, names, contents = [], [], [], []
                for k, (b, ends) in enumerate(zip(bare, chunk_ends(bare, gear), strict=True)):
                    last = 0
                    for i, e in enumerate(ends):
                        row.append(at + k)
                        place.append(i)
                        contents.append(b[last:e])
                        names.append(_signed(xxhash.xxh3_64_intdigest(b[last:e]), hash_bits))
                        last = e
                columns = {"chunk": pa.array(names, pa.int64()), "content": pa.array(contents, pa.binary())}
                if with_row:
                    digests = [hashlib.sha256(b).hexdigest() for b in bare]
                    columns |= {
                        "doc_id": ids.take(pa.array(row, pa.int64())),
                        "n_code_points": pa.array([len(texts[r]) for r in row], pa.int64()),
                        "text_sha256": pa.array([digests[r - at] for r in row], pa.string()),
                        "place": pa.array(place, pa.int32()),
                    }
                yield pa.RecordBatch.from_pydict(columns)
                at = to

    return run


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    hash_bits narrows the chunk hash; tests use it to force collisions.
    """
    ship()
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_or_empty().alias("text"))
    contents = source.mapInArrow(_chunks(hash_bits, False), "chunk long, content binary").groupBy("chunk", "content").agg(F.count("*").alias("n"))
    collided = contents.groupBy("chunk").agg(F.count("*").alias("contents")).filter("contents > 1").select("chunk")
    collided = checkpoint(collided)
    few = collided.limit(MOST_COLLIDED + 1).collect()
    if len(few) <= MOST_COLLIDED:
        several = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r["chunk"] for r in few), np.int64))
        rows = source.mapInArrow(_recipes(hash_bits, several), f"doc_id {kind}, n_code_points long, text_sha256 string, recipe array<long>, contents array<binary>")
        rows = rows.withColumn("recipe", F.struct("recipe", "contents")).drop("contents")
    else:
        place = F.struct("place", F.struct("chunk", F.when(F.col("shared"), F.col("content")).alias("content")).alias("id"))
        rows = (
            source.mapInArrow(_chunks(hash_bits, True), f"chunk long, content binary, doc_id {kind}, n_code_points long, text_sha256 string, place int")
            .join(collided.withColumn("shared", F.lit(True)), "chunk", "left")
            .groupBy("doc_id", "n_code_points", "text_sha256", "place")
            .agg(F.count("*").alias("copies"), F.min(place).alias("at"))
            .groupBy("doc_id", "n_code_points", "text_sha256")
            .agg(F.min("copies").alias("copies"), F.sort_array(F.collect_list("at")).alias("recipe"))
            .withColumn("recipe", F.col("recipe.id"))
            .select("doc_id", "n_code_points", "text_sha256", "recipe", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .drop("copy")
        )
    rows = checkpoint(rows.groupBy("doc_id", "n_code_points", "text_sha256", "recipe").agg(F.count("*").alias("copies")))
    best = F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"))
    groups = checkpoint(rows.groupBy("recipe").agg(F.min(best).alias("best"), F.sum("copies").alias("group_size")))
    places = F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return (
        rows.join(groups, "recipe")
        .withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.id")) & (-F.col("n_code_points") == F.col("best.col1")))
        .select("doc_id", F.col("best.id").alias("keep_id"), "group_size", "stays", "text_sha256", places.alias("place", "copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("place") == 0)).alias("kept"), "text_sha256")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keep = exact_groups(docs).filter("kept").select(named("doc_id").alias("_name"), F.col("text_sha256").alias("_sha"))
    bare = reduce(lambda text, space: F.replace(text, F.lit(space), F.lit("")), " \n\t\r\x0b\x0c", text_or_empty())
    sha = F.coalesce(F.sha2(bare, 256), F.lit(""))  # never null: else a filter would compute it once more
    own = docs.withColumns({"_name": named("doc_id"), "_sha": sha, "_order": row_hash(docs)}).join(keep, ["_name", "_sha"], "left_semi")
    # Equal texts under one doc_id: the longest stays, then the first by its columns' hash.
    order = Window.partitionBy("_name", "_sha").orderBy(F.length(text_or_empty()).desc(), "_order")
    return own.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select(*docs.columns)


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE_SQL = {
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)"""
}
