"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenised and cut into pieces of at most one sequence. The pieces' lengths, rounded
up to a grain, form a histogram of bounded size. A linear program over packing patterns of that
histogram is solved by column generation: the simplex method holds one pattern per length class
and an unbounded knapsack, solved by dynamic programming over the duals, prices new patterns.
Patterns are rounded down, the few pieces left over are placed by best fit, and each class's
pieces, ranked, are dealt to the pattern slots.

Only the histogram (at most ``capacity / grain`` counts) reaches the driver. Ranks within a class
are counted in salted groups of about ``GROUP`` pieces, so a class that holds most pieces is split.

Defined cases: null text counts as empty; an empty text has one token, the end. Repeated rows are
packed each on its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrow.llm.common import checkpoint, kept_by_worker, ship, table, text_or_empty

CAPACITY = 4096
GRAIN = 16
END_ID = 2
#: Pieces in a group that one task ranks.
GROUP = 8000
#: Chunks between ASCII white space whose ids a worker remembers, under 200 bytes each.
REMEMBERED = 1_000_000
#: New words that go through the model in one call.
TOGETHER = 2000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A chunk in lower case: letters that normalization leaves as they are, perhaps with ASCII marks behind; or anything else.
CHUNK = re.compile(f"(?m)^(?:([a-zß-öø-ÿ]+)([{re.escape(punctuation)}]*)|(.*))$")


class _Ids(dict):
    """Numbers of chunks of text between ASCII white space; ``parts`` has their ids as little-endian bytes.

    The tokenizer drops white space and never looks across it, so a text's ids are its chunks' ids
    in order, and chunks that were met before are looked up. A new chunk of Latin letters, perhaps
    with ASCII marks behind, is two pre-tokens that normalization only turns to lower case: all
    such words go through the tokenizer's model together. Any other chunk goes through the whole
    tokenizer.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        whole = Tokenizer.from_str(model)
        self.encode = lambda chunk: np.array(whole.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.marks = {"": b""}
        self.words = Tokenizer(whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(whole.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in whole.get_vocab(False).items() if token.endswith("</w>")]] = True
        self.parts: list[bytes] = []
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self)
        return n

    def of_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of lower-case letters, some thousands of words in one call."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            data, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out.update(zip(some, [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return out

    def learn(self) -> None:
        """Gives the chunks met since the last call their parts."""
        said = [c.decode("utf-8", "replace") for c in self.new]
        found = CHUNK.findall("\n".join(said).lower()) if said else []
        own = self.of_words(list(dict.fromkeys([word for word, _, _ in found if word])))
        for mark in {mark for _, mark, _ in found}.difference(self.marks):
            self.marks[mark] = self.encode(mark)
        marks = self.marks
        self.parts += [own[word] + marks[mark] if word else self.encode(chunk) for chunk, (word, mark, _) in zip(said, found, strict=True)]
        self.new = []

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. A few megabytes at a time are cut into chunks."""
        at = 0
        while at < len(texts):
            if len(self) > REMEMBERED:
                self.clear()
                self.parts = []
            numbers, size = [], 0
            while at < len(texts) and size < 1 << 22:
                numbers.append(list(map(self.__getitem__, texts[at].encode("utf-8", "replace").split())))
                size += len(texts[at])
                at += 1
            self.learn()
            part = self.parts.__getitem__
            for own in numbers:
                yield b"".join(map(part, own))


def _pieces(model, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept_by_worker(_Ids, model.value)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, data in enumerate(ids.texts(batch.column("text").to_pylist())):
                data += end
                n = len(data) // 4
                for a in range(0, n, capacity):
                    b = min(a + capacity, n)
                    row.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def _best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each class that fill a sequence for the highest value: unbounded knapsack by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fitting = np.searchsorted(sizes, c, side="right")
        if fitting:
            gains = best[c - sizes[:fitting]] + value[:fitting]
            at = int(gains.argmax())
            if gains[at] > best[c] + 1e-12:
                best[c], last[c] = gains[at], at
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps. Like all of ``solve`` without BLAS or LAPACK, whose threads can wait for ever in a driver beside Spark."""
    n = len(a)
    both = np.concatenate((a, np.eye(n)), axis=1)
    for k in range(n):
        at = k + int(np.abs(both[k:, k]).argmax())
        both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        rate = both[:, k].copy()
        rate[k] = 0
        both -= rate[:, None] * both[k]
    return both[:, n:]


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: classes, columns: patterns) and how often the linear program uses each.

    The best pattern's value over 1 bounds how far the program is from its optimum: it ends within gap.
    """
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    times = lambda v: (inverse * v).sum(axis=1)
    used = times(demand)
    ready = [p for p, _ in _greedy(sizes, demand.astype(int), capacity)]  # a good start, before patterns are priced
    for step in range(1, rounds):
        duals = inverse.sum(axis=0)
        worth = lambda p: float((duals * p).sum())  # noqa: B023, E731
        pattern = max(ready, key=worth, default=None)
        if pattern is None or worth(pattern) <= 1 + gap:
            ready, pattern = [], _best_pattern(duals, sizes, capacity)
        if worth(pattern) <= 1 + gap:
            break
        rate = times(pattern)
        ratio = np.where(rate > 1e-9, used / np.where(rate > 1e-9, rate, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * rate, 0)
        used[out] = ratio[out]
        basis[:, out] = pattern
        if step % 100 == 0:  # keeps rounding errors from piling up
            inverse = _inverse(basis)
            used = np.maximum(times(demand), 0)
        else:
            inverse[out] /= rate[out]
            rate[out] = 0
            inverse -= rate[:, None] * inverse[out]
    return basis, used


def _greedy(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used: the largest piece, then again and again the largest that fits."""
    left, out = left.copy(), []
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), int)
        for at in np.flatnonzero(left)[::-1]:
            pattern[at] = min(room // int(sizes[at]), int(left[at]))
            room -= pattern[at] * int(sizes[at])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= times * pattern
        out.append((pattern, times))
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies by class, number of sequences) that hold all pieces of the histogram."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes])
    basis, used = solve(sizes, left.astype(float), capacity)
    out = []
    for k in np.argsort(-used):
        pattern = basis[:, k].astype(int)
        held = pattern > 0
        times = min(int(used[k] + 1e-6), int((left[held] // pattern[held]).min()))
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    out += _greedy(sizes, left, capacity)  # what rounding leaves, less than a sequence for each pattern
    return [({int(s): int(a) for s, a in zip(sizes, pattern, strict=True) if a}, times) for pattern, times in out]


def _dealt(slots: dict[int, tuple[np.ndarray, ...]]):
    """Sequence and slot of a piece by its class and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, ranks = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for c in np.unique(classes):
                mine = classes == c
                since, per, first, place = slots[int(c)]
                at = np.searchsorted(since, ranks[mine], side="right") - 1
                inside = ranks[mine] - since[at]
                sequence[mine] = first[at] + inside // per[at]
                slot[mine] = place[at] + inside % per[at]
            columns = {n: batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "slot": pa.array(slot)})

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship()
    spark = docs.sparkSession
    with open(path or tokenizer_path(), encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = checkpoint(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_pieces(model, capacity), names))
    classed = pieces.withColumn("class", F.ceil(F.col("length") / grain))
    histogram = {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()}  # at most capacity / grain rows

    slots: dict[int, list[tuple[int, int, int, int]]] = {c: [] for c in histogram}
    dealt, first = dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, capacity // grain):
        place = 0
        for c in sorted(pattern, reverse=True):
            slots[c].append((dealt[c], pattern[c], first, place))
            dealt[c] += pattern[c] * times
            place += pattern[c]
        first += times
    arrays = {c: tuple(np.array(x) for x in zip(*s, strict=True)) for c, s in slots.items()}

    groups = {c: -(-n // GROUP) for c, n in histogram.items()}
    salts = F.create_map(*(F.lit(x).cast("long") for c, n in (groups or {0: 1}).items() for x in (c, n)))
    salted = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.coalesce(salts[F.col("class")], F.lit(1))))
    sizes = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    order = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("place", F.row_number().over(order)).join(sizes, ["class", "salt"]).withColumn("rank", F.col("earlier") + F.col("place") - 1)
    placed = ranked.select(*pieces.columns, "class", "rank").mapInArrow(_dealt(arrays), names + ", sequence_id long, slot long")
    left = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(left), F.lit(0))).drop("slot")


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
