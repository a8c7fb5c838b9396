"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Sources in code point order (null last) take the weights in turn and share the
total; a target stops at ``most`` times its source's size and the excess is reshared. The mix is
counted in blocks of equal size: the highest quotients target / (2k + 1) win, first among the
sources, then, for each source, among the shards that its documents are hashed to. Within a shard
a source's documents stand in a seeded order on a ring; whole rounds come first, and the rest is
the run of blocks from a seeded block on, so at most two documents of it are cut.

Shards grow in number with the corpus, so a window never holds more than about ``shard_words``
words of one source, however large the source. The driver and one task see one row per source;
one task sees one number per shard of a source.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of
its own and comes last; documents with equal doc_id are separate rows; an empty table gives an
empty result. Reruns give the same rows. Other columns are ignored by ``mix`` and carried by
``mix_documents``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrow.llm.common import WORD, checkpoint, row_hash, ship, table, text_or_empty, words

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD_WORDS = 4_000_000
SEED = "mix-1"
#: The driver holds a row for each source; more than this is refused, not cut.
MOST_SOURCES = 1_000_000
#: Up to so many sources (a row of under 200 bytes each) their table is broadcast, beyond it is shuffled.
BROADCAST_SOURCES = 20_000


def capped_targets(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * size; the excess is reshared by weight."""
    left, weight = sum(sizes), sum(weights)
    targets = [0.0] * len(sizes)
    ratio = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for at, i in enumerate(ratio):
        if most * sizes[i] * weight < left * weights[i]:
            targets[i] = float(most * sizes[i])
            left -= most * sizes[i]
            weight -= weights[i]
        else:
            for j in ratio[at:]:
                targets[j] = left * weights[j] / weight
            break
    return targets


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients w / (2k + 1); ties go to the earlier entry.

    Any divisor gives the allocation of some number of seats, so the count starts at the natural
    divisor and single seats are added or taken back from there.
    """
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    given = [int(w * seats / total + 0.5) for w in weights]
    spare = seats - sum(given)
    if spare > 0:
        heap = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heap[0]
            given[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * given[i] + 1), i))
    elif spare < 0:
        heap = [(w / (2 * k - 1), -i) for i, (w, k) in enumerate(zip(weights, given, strict=True)) if k]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, i = heapq.heappop(heap)
            given[-i] -= 1
            if given[-i]:
                heapq.heappush(heap, (weights[-i] / (2 * given[-i] - 1), i))
    return given


def _shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard")
    quota = sainte_lague([float(x) for x in pdf["shard_size"]], int(pdf["quota"].iloc[0]))
    return pd.DataFrame({"source_no": pdf["source_no"], "shard": pdf["shard"], "blocks": np.array(quota, dtype=np.int64), "shard_size": pdf["shard_size"]})


def _number(hexadecimal):
    """The first eight digits of a hex digest as a number."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; then source, text_hash, rounds and the cuts.

    A document is taken ``rounds`` times as a whole, and its words [cut_from, cut_to) and [0, wrap_to) once more.
    """
    ship()
    spark = docs.sparkSession
    base = checkpoint(docs.select("doc_id", "source", F.size(words(text_or_empty())).cast("long").alias("size"), F.xxhash64(text_or_empty()).alias("text_hash")))
    found = base.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes = [r["size"] for r in found]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    quotas = sainte_lague(targets, round(sum(sizes) / block))
    kind = docs.schema["source"].dataType.simpleString()
    plan = spark.createDataFrame(
        [(i, r["source"], r["size"], targets[i], quotas[i]) for i, r in enumerate(found)],
        f"source_no int, name {kind}, source_size long, target double, quota long",
    )
    plan = F.broadcast(plan) if len(found) <= BROADCAST_SOURCES else plan
    shards = max(1, -(-sum(sizes) // shard_words))
    rank = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = base.join(plan, base["source"].eqNullSafe(plan["name"])).withColumn("rank", rank).withColumn("shard", _number(F.col("rank")) % shards)
    per_shard = (
        dealt.groupBy("source_no", "shard")
        .agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
        .groupBy("source_no")
        .applyInPandas(_shard_quotas, "source_no int, shard long, blocks long, shard_size long")
        .withColumn("words", F.least(F.col("blocks") * block, F.col("shard_size") * most))
        .withColumn("rounds", F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0))
        .withColumn("rest", F.col("words") - F.col("rounds") * F.col("shard_size"))
        .withColumn("first", _number(F.md5(F.concat(F.lit(seed + "/"), F.col("source_no"), F.lit("/"), F.col("shard")))) % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)) * block)
        .select("source_no", "shard", "shard_size", "rounds", "rest", "first")
    )
    line = Window.partitionBy("source_no", "shard").orderBy("rank", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(per_shard, ["source_no", "shard"])
    inside = lambda x: F.least(F.greatest(x - F.col("start"), F.lit(0)), F.col("size"))
    last = F.col("first") + F.col("rest")
    return (
        placed.withColumn("cut_from", inside(F.col("first")))
        .withColumn("cut_to", inside(last))
        .withColumn("wrap_to", inside(last - F.col("shard_size")))
        .withColumn("taken", F.col("rounds") * F.col("size") + F.col("cut_to") - F.col("cut_from") + F.col("wrap_to"))
        .select("doc_id", "size", "source_size", "target", "taken", "source", "text_hash", "rounds", "cut_from", "cut_to", "wrap_to")
    )


def _written_out(columns: list[str]):
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, out = [], []
            for k, (text, size, rounds, a, b, w) in enumerate(zip(texts, *(batch.column(c).to_pylist() for c in ("_size", "_rounds", "_cut_from", "_cut_to", "_wrap_to")), strict=True)):
                pieces = [text] * rounds
                for x, y in ((a, b), (0, w)):
                    if y - x == size > 0:
                        pieces.append(text)
                    elif y > x:
                        spans = [m.span() for m in word.finditer(text)]
                        pieces.append(text[spans[x][0] : spans[y - 1][1]])
                rows += [k] * len(pieces)
                out += pieces
            kept = batch.select(columns).take(pa.array(rows, pa.int64()))
            arrays = {c: kept.column(c) for c in columns} | {"text": pa.array(out, batch.schema.field("text").type)}
            if "n_chars" in arrays:
                arrays["n_chars"] = pa.array([len(t) for t in out], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([arrays[c] for c in columns], columns)

    return run


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each round of a document, one for each cut of it.

    n_chars, where docs has it, is that of the row's text.
    """
    keys = ["_doc_id", "_source", "_size", "_text_hash", "_copy"]
    same = Window.partitionBy(*keys[:-1])
    own = docs.withColumns({"_doc_id": F.col("doc_id"), "_source": F.col("source"), "_size": F.size(words(text_or_empty())).cast("long"), "_text_hash": F.xxhash64(text_or_empty()), "_order": row_hash(docs)}).withColumn("_copy", F.row_number().over(same.orderBy("_order")))
    plan = mix(docs, **parameters).filter("taken > 0").select(*(F.col(c).alias("_" + c) for c in ("doc_id", "source", "size", "text_hash", "rounds", "cut_from", "cut_to", "wrap_to")))
    plan = plan.withColumn("_copy", F.row_number().over(same.orderBy("_rounds", "_cut_from")))
    both = own.alias("o").join(plan.alias("p"), [F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    both = both.select(*(F.col(f"o.{c}") for c in docs.columns), F.col("o._size"), *(F.col(f"p.{c}") for c in ("_rounds", "_cut_from", "_cut_to", "_wrap_to")))
    return both.mapInArrow(_written_out(docs.columns), docs.schema)


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL = {
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')) AS rank
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][source_no % 3 + 1] AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s),
l AS (
  SELECT *, total - {MOST} * coalesce(sum(source_size) OVER before, 0)::BIGINT AS rest,
         sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS weights
  FROM w WINDOW before AS (ORDER BY {MOST} * source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {MOST} * source_size * weights < rest * weight AS capped FROM l),
u AS (SELECT arg_max(rest, weights) FILTER (NOT capped) AS rest, max(weights) FILTER (NOT capped) AS weights FROM c),
t AS (
  SELECT source, source_no, source_size, total,
         CASE WHEN capped THEN ({MOST} * source_size)::DOUBLE ELSE (u.rest * weight)::DOUBLE / u.weights END AS target
  FROM c, u),
q AS (
  SELECT source_no, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source_no, k) AS place, round_even(total / {BLOCK}, 0) AS seats
  FROM (SELECT *, unnest(range((target / {BLOCK})::BIGINT + 8)) AS k FROM t)),
quota AS (SELECT source_no, count(*) AS quota FROM q WHERE place <= seats GROUP BY source_no),
n AS (SELECT greatest(1, ceil(sum(size) / {SHARD_WORDS}))::BIGINT AS shards FROM d),
p AS (
  SELECT d.*, t.source_no, t.source_size, t.target, ('0x' || substr(rank, 1, 8))::BIGINT % n.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, n),
h AS (SELECT source_no, shard, sum(size)::BIGINT AS shard_size FROM p GROUP BY ALL),
hq AS (
  SELECT h.source_no, h.shard, row_number() OVER (PARTITION BY h.source_no ORDER BY h.shard_size::DOUBLE / (2 * k + 1) DESC, h.shard, k) AS place, quota
  FROM (SELECT h.*, quota, unnest(range(CASE WHEN shard_size = 0 THEN 0 ELSE quota END)) AS k FROM h JOIN quota USING (source_no)) h),
b AS (
  SELECT h.source_no, h.shard, shard_size, count(hq.place) FILTER (hq.place <= hq.quota) AS blocks
  FROM h LEFT JOIN hq ON h.source_no = hq.source_no AND h.shard = hq.shard GROUP BY ALL),
r AS (
  SELECT *, least(blocks * {BLOCK}, {MOST} * shard_size)::BIGINT AS words,
         (CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END)::BIGINT AS rounds, words - rounds * shard_size AS rest,
         ('0x' || substr(md5('{SEED}/' || source_no || '/' || shard), 1, 8))::BIGINT % greatest(1, ceil(shard_size / {BLOCK})::BIGINT) * {BLOCK} AS first
  FROM b),
x AS (
  SELECT p.*, r.shard_size, r.rounds, r.rest, r.first,
         coalesce(sum(size) OVER (PARTITION BY p.source_no, p.shard ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM p JOIN r ON p.source_no = r.source_no AND p.shard = r.shard)
SELECT doc_id, size, source_size, target,
       (rounds * size + least(greatest(first + rest - start, 0), size) - least(greatest(first - start, 0), size)
        + least(greatest(first + rest - shard_size - start, 0), size))::BIGINT AS taken
FROM x"""
}
