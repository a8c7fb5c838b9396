"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word is the context of a restaurant whose customers are the words that follow it; all
context restaurants share one parent, the restaurant of words alone, over a uniform base. Customers
sit by the Chinese restaurant process; each table of a context restaurant is a customer of the
parent. Seatings are sampled by blocked Gibbs steps. The product of (strength + discount k) over a
restaurant's tables is an integral over a gamma variable v; given v, the dishes are independent and
a dish with c customers has t tables with a weight of S(c, t) (discount v p1)^t, S the generalized
Stirling numbers. A step draws v for each restaurant, then all customers' tables of each dish at
once. Predictive probabilities are averaged over samples.

The counts are all (context, word) pairs of all training texts. Nothing of the size of the
vocabulary is held in one place:

A. a task turns its texts into units: per bucket of contexts, the unit's pairs with their training
   counts, each pair once however many documents hold it; the documents' occurrences stay together;
B. a bucket merges its units' pairs and sends word counts and one table for each pair to the
   partitions of the vocabulary; with the parent that C makes of all buckets' tables, it seats its
   restaurants and sends their tables;
C. a vocabulary partition sums them, seats the parent's tables and answers each bucket that asked;
   the sums over all partitions are added up and handed to all buckets;
D. a bucket goes on seating with the answers, averages its predictions and answers each unit with
   the probabilities of its pairs;
E. a unit adds up its documents' occurrences.

A's output is shuffled once and read by B, twice, and by D. Pairs travel as compressed arrays; a
message is sent only where there is something to say, so the messages of a unit are at most its
pairs, and those of a bucket at most its words. Contexts with more than half a bucket's share of
all tokens are split by word, and their totals are summed in C. Buckets and partitions grow in
number with the texts, so their size stays the same; a pair costs its bucket one entry per unit.

Defined cases: null text is empty and has one token, the end; a null doc_id counts as the empty
text in the fold; repeated rows are scored and counted each; an empty table gives an empty result;
without training texts every score is that of the base. Words are told apart by 64-bit hashes.
Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm.common import SQL_CRC32, SQL_LOWER, SQL_WORDS, checkpoint, ship, small_batches, table, text_or_empty

#: Discounts and strengths of context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 1.0
#: Gibbs steps before tables are sent to the parent, before the first sample, and the samples averaged.
FIRST_STEPS, BURN_IN, SAMPLES = 4, 4, 4
#: Generalized Stirling numbers are tabled up to so many customers; beyond, they are a series of so many terms up to so many times customers ** discount tables.
TABLED, TERMS, SERIES = 1024, 160, 2.5
#: Characters of text for one bucket, and tokens of a unit.
BUCKET_CHARS, UNIT_TOKENS = 20_000_000, 5_000_000
SEED = 11
#: Probabilities travel as logarithms with so many binary places.
SCORE_BITS = 18
#: Ids of the start of a text and of the end token; words have their hash.
START, END = 1, 2
#: Pairs are numbered by bucket, context and word where that fits.
LARGEST_CODE = (1 << 63) - 1


def _dump(**arrays: np.ndarray) -> bytes:
    """Arrays, bytes of equal weight side by side, compressed."""
    head = [(k, v.dtype.str, len(v)) for k, v in arrays.items()]
    body = b"".join(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1).T.tobytes() for v in arrays.values() if len(v))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((head, body)))


def _load(data: bytes) -> dict[str, np.ndarray]:
    head, body = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    out, at = {}, 0
    for name, kind, n in head:
        size = n * np.dtype(kind).itemsize
        out[name] = np.frombuffer(body, np.uint8, size, at).reshape(-1, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind)
        at += size
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _split_of(contexts: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Into how many parts each context is split."""
    names, parts = hot
    out = np.ones(len(contexts), np.uint64)
    if len(names):
        at = np.minimum(np.searchsorted(names, contexts), len(names) - 1)
        found = names[at] == contexts
        out[found] = parts[at[found]]
    return out


def _unit(ids: list[np.ndarray], docs: list[tuple[int | None, bool]], vocabulary: dict[bytes, int], buckets: int, hot) -> Iterator[tuple]:
    """Rows (bucket, is_docs, payload) for the documents of a unit: its pairs by bucket, in the order of which the documents' occurrences are kept."""
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    names = np.concatenate((names, np.array([START, END], np.uint64)))
    v = len(names)
    # Words are numbered by name, so that pairs come by bucket, context and word.
    number = np.empty(v, np.int32)
    number[np.argsort(names, kind="stable")] = np.arange(v, dtype=np.int32)
    names, start, end = np.sort(names), number[v - 2], number[v - 1]
    lengths = np.fromiter((len(x) + 1 for x in ids), np.int64, len(ids))
    ends = np.cumsum(lengths) - 1
    words = np.full(int(lengths.sum()), end, np.int32)
    inner = np.ones(len(words), bool)
    inner[ends] = False
    words[inner] = number[np.concatenate(ids)] if ids else []
    contexts = np.concatenate((number[v - 2 : v - 1], words[:-1]))
    contexts[ends[:-1] + 1] = start
    bucket = (_mix(names) % np.uint64(buckets)).astype(np.int64)[contexts]
    parts = _split_of(names, hot)
    for at in np.array_split(np.flatnonzero(parts[contexts] > 1), 8):  # the words of split contexts have buckets of their own
        part = (names[words[at]] >> np.uint64(20)) % parts[contexts[at]]
        bucket[at] = _mix(names[contexts[at]] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    if buckets * v * v <= LARGEST_CODE:
        code = bucket  # bucket, context and word in one number
        for array in (contexts, words):
            code *= v
            code += array
        del bucket, contexts, words, inner
        order = np.argsort(code, kind="stable")  # keeps documents in order within a pair
        code = code[order]
        triple = lambda code, at: (*np.divmod(code[at] // v, v), code[at] % v)
    else:
        order = np.lexsort((words, contexts, bucket))
        sorted_ = [x[order] for x in (bucket, contexts, words)]
        code = np.cumsum(np.concatenate(([False], np.any([x[1:] != x[:-1] for x in sorted_], axis=0))))
        triple = lambda code, at: tuple(x[at].astype(np.int64) for x in sorted_)
    doc = doc[order]
    del order
    entry = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))))
    times = np.diff(np.concatenate((entry, [len(code)]))).astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], code[entry][1:] != code[entry][:-1])))
    entries = np.diff(np.concatenate((first, [len(entry)]))).astype(np.int32)
    bucket, u, w = triple(code, entry[first])
    doc = doc[entry]
    del code, entry
    train = np.fromiter((not held for _, held in docs), bool, len(docs))
    trained = np.add.reduceat(np.where(train[doc], times, 0), first).astype(np.int32)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, local = np.unique(np.concatenate((u[x:y], w[x:y])), return_inverse=True)
        lu, lw = local[: y - x], local[y - x :]
        yield int(bucket[x]), False, _dump(names=np.diff(names[own], prepend=np.uint64(0)), u=np.diff(lu, prepend=0).astype(np.int32), w=lw.astype(np.int32), trained=trained[x:y])
    known = np.fromiter((d is not None for d, _ in docs), bool, len(docs))
    ids_ = np.fromiter((d or 0 for d, _ in docs), np.int64, len(docs))
    # Within a pair documents rise, so their steps are small numbers.
    steps = np.diff(doc, prepend=np.int32(0))
    steps[first] = doc[first]
    yield -1, True, _dump(doc_id=ids_, known=known, held=~train, tokens=lengths, entries=entries, doc=steps, times=times)


def _word_unit(ids: list[np.ndarray], docs: list[tuple[int | None, bool]], vocabulary: dict[bytes, int], buckets: int, _) -> Iterator[tuple]:
    """The same of a unit's words alone: rows (bucket, is_docs, payload) with its words by bucket."""
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    names = np.concatenate((names, np.array([END], np.uint64)))
    bucket = (_mix(names) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((names, bucket))
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    names, bucket, end = names[order], bucket[order], number[-1]
    lengths = np.fromiter((len(x) + 1 for x in ids), np.int64, len(ids))
    words = np.full(int(lengths.sum()), end, np.int64)
    inner = np.ones(len(words), bool)
    inner[np.cumsum(lengths) - 1] = False
    words[inner] = number[np.concatenate(ids)]
    words *= len(ids)  # word and document in one number
    words += np.repeat(np.arange(len(ids)), lengths)
    code, times = np.unique(words, return_counts=True)
    del words, inner
    word, doc = np.divmod(code, len(ids))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    entries = np.diff(np.concatenate((first, [len(word)]))).astype(np.int32)
    train = np.fromiter((not held for _, held in docs), bool, len(docs))
    trained = np.add.reduceat(np.where(train[doc], times, 0), first).astype(np.int32)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[x]), False, _dump(names=np.diff(names[x:y], prepend=np.uint64(0)), trained=trained[x:y])
    known = np.fromiter((d is not None for d, _ in docs), bool, len(docs))
    ids_ = np.fromiter((d or 0 for d, _ in docs), np.int64, len(docs))
    steps = np.diff(doc, prepend=0).astype(np.int32)
    steps[first] = doc[first]
    yield -1, True, _dump(doc_id=ids_, known=known, held=~train, tokens=lengths, entries=entries, doc=steps, times=times.astype(np.int32))


def _units(buckets: int, hot, unit_rows=_unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_ = hot and hot.value
        ids, docs, vocabulary, tokens = [], [], _Vocabulary(), 0
        unit = TaskContext.get().partitionId() << 24  # a name that no other task gives

        def flush():
            for b, is_docs, payload in unit_rows(ids, docs, vocabulary, buckets, hot_):
                b = -1 - unit % (1 << 24) - (unit >> 24) * 64 if is_docs else b  # keys of their own
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([b], pa.int32()), "unit": pa.array([unit], pa.int64()), "is_docs": pa.array([is_docs]), "payload": pa.array([payload], pa.binary())}
                )

        for batch in small_batches(batches):
            for text, doc, held in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "held_out")), strict=True):
                words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z alone
                ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                docs.append((doc, held))
                tokens += len(words) + 1
                if tokens >= UNIT_TOKENS:
                    yield from flush()
                    ids, docs, vocabulary, tokens, unit = [], [], _Vocabulary(), 0, unit + 1
        if docs:
            yield from flush()

    return run


@lru_cache(4)
def _ratios(discount: float) -> np.ndarray:
    """S(c, t + 1) / S(c, t) at [c, t], for c up to TABLED."""
    out, row = np.zeros((TABLED + 1, TABLED + 1)), np.full(TABLED + 2, -np.inf)
    row[1] = 0.0
    t = np.arange(TABLED + 2)
    for c in range(2, TABLED + 1):
        row[1 : c + 1] = np.logaddexp(row[:c], np.log(np.maximum(c - 1 - t[1 : c + 1] * discount, 1e-300)) + row[1 : c + 1])
        out[c, 1:c] = np.exp(row[2 : c + 1] - row[1:c])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - sum(np.log(x + k) for k in range(8))


def log_stirling(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) for c > TABLED: its alternating sum while that converges fast, the saddle point of its generating function beyond."""
    switch = int(SERIES * c**discount)
    out, few = np.zeros(len(t)), t <= switch
    x = t[few].astype(float)[:, None]
    j = np.arange(1, TERMS + 1)
    # C(t, j) gamma(c - jd) gamma(1 + jd) sin(pi jd) / pi with alternating signs
    logs = -_log_gamma(np.maximum(x - j, 0) + 1) - _log_gamma(j + 1.0) + _log_gamma(c - j * discount) + _log_gamma(1 + j * discount)
    logs = np.where(j <= x, logs, -np.inf)
    top = logs.max(axis=1, initial=-np.inf, keepdims=True)
    total = (np.exp(logs - top) * (np.where(j % 2, 1.0, -1.0) * np.sin(np.pi * j * discount) / np.pi)).sum(axis=1)
    out[few] = np.log(total) + top[:, 0] - t[few] * np.log(discount)
    if few.all():
        return out
    x = np.append(t[~few], switch).astype(float)
    low, high = np.full(len(x), -60.0), np.zeros(len(x))  # log of y = 1 - x
    for _ in range(60):
        y = np.exp(mid := (low + high) / 2)
        over = x * (1 - y) * discount * y ** (discount - 1) > c * (1 - y**discount)
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    y = np.minimum(np.exp((low + high) / 2), 1 - 1e-12)
    spread = c * np.maximum(1 + (1 - y) * (1 - discount) / y - c / x, 1e-12)
    logs = _log_gamma(np.array(c + 1.0)) - _log_gamma(x + 1) - x * np.log(discount) + x * np.log1p(-(y**discount)) - c * np.log1p(-y) - 0.5 * np.log(2 * np.pi * spread)
    out[~few] = logs[:-1] - logs[-1] + log_stirling(c, np.array([switch]), discount)  # joined without a step
    out[t == c] = 0.0
    return out


@lru_cache(4096)
def _log_stirlings(c: int, most: int, discount: float) -> np.ndarray:
    return log_stirling(c, np.arange(1, most + 1), discount)


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """For each dish with c > 1 customers a number of tables t, drawn with a weight of S(c, t) a^t."""
    out, ratios = np.ones(len(c), np.int64), _ratios(discount)
    live = np.flatnonzero(c <= TABLED)
    cl, al, last, t = c[live], a[live], np.ones(len(live)), 1  # last: the weight of t among all up to t
    while len(live):
        ratio = ratios[cl, t] * al
        last = last * ratio / (1 + last * ratio)
        t += 1
        out[live[rng.random(len(live)) < last]] = t
        on = (cl > t) & ((last > 1e-13) | (ratio > 0.9))
        live, cl, al, last = live[on], cl[on], al[on], last[on]
    for i in np.flatnonzero(c > TABLED).tolist():
        n, most, log_a = int(c[i]), 64, np.log(a[i])
        while True:
            most = min(most, n)
            logs = _log_stirlings(n, most, discount) + np.arange(1, most + 1) * log_a
            if most == n or logs[-1] < logs.max() - 40:  # falls on from there
                break
            most *= 4
        sums = np.cumsum(np.exp(logs - logs.max()))
        out[i] = 1 + min(int(np.searchsorted(sums, rng.random() * sums[-1], side="right")), most - 1)
    return out


class _Bucket:
    """The merged pairs of a bucket. names: its words and contexts, sorted; u and w index them."""

    def __init__(self, payloads: list[bytes], hot):
        parts = [_load(p) for p in payloads]
        own = [np.cumsum(p["names"], dtype=np.uint64) for p in parts]
        self.names = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        v = max(1, len(self.names))
        codes = []
        for p, names in zip(parts, own, strict=True):
            to = np.searchsorted(self.names, names)
            codes.append(to[np.cumsum(p.pop("u"), dtype=np.int64)] * v + to[p.pop("w")])
        pairs, index = np.unique(np.concatenate(codes), return_inverse=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.u, self.w = np.divmod(pairs, v)
        self.c = np.bincount(index, np.concatenate([p["trained"] for p in parts]) if parts else None, len(pairs)).astype(np.int64)
        at = np.cumsum([0, *map(len, codes)])
        self.parts = [index[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]  # the places of each unit's pairs
        self.split = _split_of(self.names, hot) > 1
        self.cu = np.bincount(self.u, self.c, v)
        self.seated = self.c > 0
        self.t = self.seated.astype(np.int64)  # tables by pair; a dish with one customer has one
        self.random = np.random.default_rng([SEED, int(self.names[:1].sum()) & 0xFFFF, len(pairs)])

    def tables_of_contexts(self) -> np.ndarray:
        return np.bincount(self.u, self.t, max(1, len(self.names)))

    @property
    def many(self) -> np.ndarray:
        """The dishes with several customers."""
        return np.flatnonzero(self.c > 1)

    @property
    def since(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.t[self.many])))

    @property
    def sizes(self) -> np.ndarray:
        """Customers by table of these dishes: all are alone but those of the first. Predictions need the tables' number alone."""
        out = np.ones(self.since[-1], np.int64)
        out[self.since[:-1]] = self.c[self.many] - self.t[self.many] + 1
        return out

    def step(self, p1: np.ndarray, tables: np.ndarray) -> None:
        """One Gibbs step: each context's latent weight given its tables, then each dish's tables given that weight."""
        weight = DISCOUNT * self.random.gamma(STRENGTH / DISCOUNT + tables)
        self.t[self.many] = draw_tables(self.c[self.many], weight[self.u[self.many]] * p1[self.w[self.many]], DISCOUNT, self.random)


def _seated(b: _Bucket | list[bytes], hot, p1: np.ndarray | None = None) -> tuple[_Bucket, np.ndarray]:
    """A bucket after its first steps; without a parent that is estimated from the bucket's own tables."""
    b = _Bucket(b, hot) if isinstance(b, list) else b
    if p1 is None:
        own = np.bincount(b.w, b.seated, max(1, len(b.names)))
        p1 = (own + 0.5) / max(1.0, (own + 0.5).sum())
    parts = np.append(_split_of(b.names, hot), np.ones(int(not len(b.names)), np.uint64)).astype(np.int64)
    for _ in range(FIRST_STEPS):
        b.step(p1, b.tables_of_contexts() * parts)
    return b, p1


def _payloads(t: pa.Table, is_docs: bool) -> list[tuple[int, bytes]]:
    t = t.filter(pc.equal(t.column("is_docs"), is_docs))
    return sorted(zip(t.column("unit").to_pylist(), t.column("payload").to_pylist(), strict=True))


def _partition(names: np.ndarray, partitions: int) -> np.ndarray:
    return (_mix(names ^ np.uint64(0xABCDEF)) % np.uint64(partitions)).astype(np.int64)


def _answered(b: _Bucket, rows: pa.Table, partitions: int, last: bool) -> tuple[dict[str, np.ndarray], list[float], np.ndarray]:
    """What the vocabulary partitions said of the bucket's words, first or last; their sums; the parent's probabilities."""
    v = len(b.names)
    to = _partition(b.names, partitions)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(partitions + 1))
    got = {name: np.zeros(max(1, v)) for name in ("c", "customers", "tables", "cu", "tu")}
    for k, is_last, payload, said in zip(*(rows.column(x).to_pylist() for x in ("part", "is_last", "payload", "sums")), strict=True):
        if is_last != last:
            continue
        if said is not None:
            sums = said
            continue
        arrays, mine = _load(payload), order[cuts[k] : cuts[k + 1]]
        for name, array in got.items():
            array[mine] = arrays[name]
    _, distinct, seated, parent_tables = sums
    back = (PARENT_STRENGTH + PARENT_DISCOUNT * parent_tables) / (distinct + 1)
    return got, sums, (np.maximum(got["customers"] - PARENT_DISCOUNT * got["tables"], 0) + back) / (PARENT_STRENGTH + seated)


def _asked(b: _Bucket, bucket: int, partitions: int) -> pa.Table:
    """The bucket's counts and tables, by vocabulary partition."""
    v = len(b.names)
    count, tables, cu, tu = (np.bincount(i, x, max(1, v))[:v].astype(np.int64) for i, x in ((b.w, b.c), (b.w, b.t), (b.u, b.c * b.split[b.u]), (b.u, b.t * b.split[b.u])))
    to = _partition(b.names, partitions)
    order = np.argsort(to, kind="stable")
    parts, cuts = np.unique(to[order], return_index=True)
    payloads = [_dump(names=np.diff(b.names[m], prepend=np.uint64(0)), c=count[m].astype(np.int32), t=tables[m].astype(np.int32), cu=cu[m], tu=tu[m]) for m in np.split(order, cuts[1:])] if v else []
    return pa.table({"part": pa.array(parts, pa.int32()), "bucket": pa.array([bucket] * len(payloads), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _stage_types(partitions: int, hot):
    """A bucket with one table for each dish."""

    def run(key, t):
        return _asked(_Bucket([p for _, p in _payloads(t, False)], hot.value), key[0].as_py(), partitions)

    return run


def _stage_b(partitions: int, hot):
    def run(key, left, right):
        b = _Bucket([p for _, p in _payloads(left, False)], hot.value)
        if len(b.names):
            b, _ = _seated(b, hot.value, _answered(b, right, partitions, False)[2])
        return _asked(b, key[0].as_py(), partitions)

    return run


def _parent_tables(customers: np.ndarray, words: int, partitions: int, rng: np.random.Generator) -> np.ndarray:
    """Mean tables of each dish of the parent over samples, by Gibbs steps like those of the contexts."""
    t, mean = (customers > 0).astype(np.int64), np.zeros(len(customers))
    many = np.flatnonzero(customers > 1)
    for k in range(FIRST_STEPS + BURN_IN + SAMPLES):
        weight = PARENT_DISCOUNT * rng.gamma(PARENT_STRENGTH / PARENT_DISCOUNT + t.sum() * partitions)
        t[many] = draw_tables(customers[many], np.full(len(many), weight / (words + 1)), PARENT_DISCOUNT, rng)
        if k >= FIRST_STEPS + BURN_IN:
            mean += t / SAMPLES
    return mean


def _stage_c(partitions: int, only_sums: bool):
    """Answers to the buckets, or the partition's sums: tokens, words, tables of contexts, tables of the parent."""

    def run(key, t):
        part = key[0].as_py()
        rows = sorted(zip(t.column("bucket").to_pylist(), t.column("payload").to_pylist(), strict=True))
        parts = [_load(p) for _, p in rows]
        own = [np.cumsum(p["names"], dtype=np.uint64) for p in parts]
        names, index = np.unique(np.concatenate(own), return_inverse=True)
        total = {k: np.bincount(index, np.concatenate([p[k] for p in parts]), len(names)).astype(np.int64) for k in ("c", "t", "cu", "tu")}
        # Partitions are alike: the parent's words and tables are as many times those of this one.
        words = int((total["c"] > 0).sum()) * partitions
        tables = _parent_tables(total["t"], words, partitions, np.random.default_rng([SEED, part]))
        if only_sums:
            return pa.table({"sums": pa.array([[float(x) for x in (total["c"].sum(), (total["c"] > 0).sum(), total["t"].sum(), tables.sum())]], pa.list_(pa.float64()))})
        at, out = 0, []
        for (bucket, _), n in zip(rows, map(len, own), strict=True):
            i = index[at : at + n]
            at += n
            out.append((bucket, _dump(c=total["c"][i], customers=total["t"][i], tables=tables[i].astype(np.float32), cu=total["cu"][i], tu=total["tu"][i])))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "part": pa.array([part] * len(out), pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})

    return run


def _stage_d(partitions: int, hot):
    def run(key, left, right):
        units = _payloads(left, False)
        if not units:  # documents alone
            return told(key, [(unit, True, payload) for unit, payload in _payloads(left, True)], 0, 0)
        b = _Bucket([p for _, p in units], hot.value)
        b, _ = _seated(b, hot.value, _answered(b, right, partitions, False)[2])  # as in B
        v = len(b.names)
        got, (n_train, distinct, _, _), p1 = _answered(b, right, partitions, True)
        c, cu, tu = got["c"], got["cu"], got["tu"]
        # A split context takes its totals from all its parts.
        all_c = np.where(np.append(b.split, np.zeros(max(1, v) - v, bool)), cu, b.cu)
        split, own = np.append(b.split, np.zeros(max(1, v) - v, bool)), b.tables_of_contexts()
        grow = np.where(split & (own > 0), tu / np.maximum(own, 1), 1)  # the other parts' tables change as this one's do
        totals = lambda: np.where(split & (own == 0), tu, b.tables_of_contexts() * grow)  # noqa: B023, E731
        p = np.zeros(len(b.u))
        for k in range(BURN_IN + SAMPLES):
            b.step(p1, totals())
            if k >= BURN_IN:
                t = totals()
                p += (b.c - DISCOUNT * b.t + (STRENGTH + DISCOUNT * t[b.u]) * p1[b.w]) / (STRENGTH + all_c[b.u]) / SAMPLES
        logs = np.rint(-np.log10(p) * 2.0**SCORE_BITS).astype(np.int32)
        counts = c[b.w].astype(np.int64)
        counts = counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts
        return told(key, [(unit, False, _dump(logs=logs[index], c=counts[index])) for (unit, _), index in zip(units, b.parts, strict=True)], n_train, distinct)

    def told(key, rows, n_train, distinct):
        n = len(rows)
        return pa.table(
            {
                "unit": pa.array([u for u, _, _ in rows], pa.int64()),
                "is_docs": pa.array([d for _, d, _ in rows], pa.bool_()),
                "bucket": pa.array([key[0].as_py()] * n, pa.int32()),
                "payload": pa.array([p for _, _, p in rows], pa.binary()),
                "n_train": pa.array([int(n_train)] * n, pa.int64()),
                "distinct": pa.array([int(distinct)] * n, pa.int64()),
            }
        )

    return run


def _stage_e(key, t):
    t = t.sort_by([("is_docs", "ascending"), ("bucket", "ascending")])
    *said, docs = map(_load, t.column("payload").to_pylist())  # pairs by bucket, as the unit has them
    logs, c = (np.concatenate([p[k] for p in said]) for k in ("logs", "c"))
    n_train, distinct = (t.column(k)[0].as_py() for k in ("n_train", "distinct"))
    n, entries = len(docs["doc_id"]), docs["entries"]
    pair = np.repeat(np.arange(len(entries)), entries)
    first = np.cumsum(entries) - entries
    doc = np.cumsum(docs["doc"], dtype=np.int64)
    doc -= np.repeat(doc[first] - docs["doc"][first], entries)  # steps begin anew with each pair
    total = lambda x: np.bincount(doc, x[pair] * docs["times"], n)
    score = total(-logs / 2.0**SCORE_BITS)
    return pa.table(
        {
            "doc_id": pa.array(docs["doc_id"], pa.int64(), mask=~docs["known"]),
            "held_out": pa.array(docs["held"]),
            "n_tokens": pa.array(docs["tokens"], pa.int64()),
            "n_known": pa.array(total((c > 0).astype(float)).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, n_train, np.int64)),
            "base_score": pa.array(0.0 + total(np.log10((c + 1) / (n_train + distinct + 1))), pa.float64()),
            "score": pa.array(0.0 + score, pa.float64()),
            "perplexity": pa.array(10.0 ** (-score / docs["tokens"]), pa.float64()),
        }
    )


def _word_counts(key, t):
    """A bucket's counts of its words, for each unit that has them; its tokens and words in training stand in the first row. A unit's documents pass."""
    payloads = t.column("payload").to_pylist()
    n = v = 0
    if key[0].as_py() >= 0:
        said = [_load(p) for p in payloads]
        words, at = np.unique(np.concatenate([np.cumsum(p["names"]) for p in said]), return_inverse=True)
        c = np.bincount(at, np.concatenate([p["trained"] for p in said]), len(words)).astype(np.int64)
        n, v = int(c.sum()), int((c > 0).sum())
        cuts = np.cumsum([len(p["names"]) for p in said])[:-1]
        payloads = [_dump(logs=np.zeros(len(x), np.int8), c=c[x]) for x in np.split(at, cuts)]
    rest = [0] * (len(payloads) - 1)
    columns = {"n": pa.array([n, *rest], pa.int64()), "v": pa.array([v, *rest], pa.int64())}
    return pa.table({"unit": t.column("unit"), "is_docs": t.column("is_docs"), "bucket": t.column("bucket"), "payload": pa.array(payloads, pa.binary()), **columns})


def _frequent(share: float):
    """A task's words with more than this share of its tokens, and its tokens under START."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(text.encode("utf-8", "replace").lower().split())
            tokens = counts.total()
            often = [(xxhash.xxh3_64_intdigest(w), n) for w, n in counts.items() if n > max(8, share * tokens)]
            often += [(START, batch.num_rows), (END, tokens + batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"name": pa.array(np.array([k for k, _ in often], np.uint64).view(np.int64)), "n": pa.array([n for _, n in often], pa.int64())})

    return run


def _dealt(docs: DataFrame, folds: int, held: int, bucket_chars: int) -> tuple[DataFrame, int]:
    """The documents with their fold and text, and the number of buckets for them."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), text_or_empty().alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows, max(2, -(-chars // bucket_chars))


def score(docs: DataFrame, folds: int = 7, held: int = 2, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the documents whose crc32(doc_id as text) mod folds is not held.
    """
    ship()
    context = docs.sparkSession.sparkContext
    rows, buckets = _dealt(docs, folds, held, bucket_chars)
    share = 0.5 / buckets
    often = checkpoint(rows.select("text").mapInArrow(_frequent(share / 4), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")))
    tokens = (often.filter(F.col("name") == END).first() or {"n": 0})["n"]
    # At most 2 * buckets names, 16 bytes each, are over the share.
    found = often.filter((F.col("name") != END) & (F.col("n") > share * tokens)).orderBy("name").collect()
    names = np.array([r["name"] for r in found], np.int64).view(np.uint64)
    parts = np.array([max(1, -(-int(r["n"] / (share * max(1, tokens))) // 1)) for r in found], np.uint64)
    order = np.argsort(names)
    hot = context.broadcast((names[order], parts[order]))

    units = rows.mapInArrow(_units(buckets, hot), "bucket int, unit long, is_docs boolean, payload binary")
    asked = "part int, bucket int, payload binary"

    def answers(tables: DataFrame, last: bool) -> DataFrame:
        """What the vocabulary says to the buckets that asked, and its sums to all buckets."""
        by_part = tables.groupBy("part")
        said = by_part.applyInArrow(_stage_c(buckets, False), "bucket int, part int, payload binary").withColumn("sums", F.lit(None).cast("array<double>"))
        sums = by_part.applyInArrow(_stage_c(buckets, True), "sums array<double>")
        sums = sums.agg(F.array(*(F.coalesce(F.sum(F.get("sums", F.lit(k))), F.lit(0.0)) for k in range(4))).alias("sums"))
        told = sums.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("payload"), "sums")
        return said.union(told).withColumn("is_last", F.lit(last))

    first = answers(units.groupBy("bucket").applyInArrow(_stage_types(buckets, hot), asked), False)
    tables = units.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(_stage_b(buckets, hot), asked)
    both = first.union(answers(tables, True))
    kinds = "unit long, is_docs boolean, bucket int, payload binary, n_train long, distinct long"
    done = units.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(_stage_d(buckets, hot), kinds)
    scores = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return done.groupBy("unit").applyInArrow(_stage_e, scores)


def op1_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))


def base_scores(docs: DataFrame, folds: int = 7, held: int = 2, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """The columns of ``score`` that need no seating: doc_id, held_out, n_tokens, n_known, train_tokens, base_score.

    A bucket merges its units' words and answers each unit with their counts; the units' documents wait beside them.
    """
    ship()
    rows, buckets = _dealt(docs, folds, held, bucket_chars)
    units = rows.mapInArrow(_units(buckets, None, _word_unit), "bucket int, unit long, is_docs boolean, payload binary")
    counted = units.groupBy("bucket").applyInArrow(_word_counts, "unit long, is_docs boolean, bucket int, payload binary, n long, v long")
    sums = counted.agg(F.sum("n").alias("n_train"), F.sum("v").alias("distinct"))
    scores = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    done = counted.drop("n", "v").crossJoin(sums).groupBy("unit").applyInArrow(_stage_e, scores)
    return done.drop("score", "perplexity")


def lm_base_scores(spark, sf_dir):
    """What of op1 SQL can express: the counts and the base score."""
    return base_scores(table(spark, sf_dir, "documents")).withColumn("base_score", F.round("base_score", 3))


QUERIES = {"op1_lm_scoring": op1_lm_scoring, "lm_base_scores": lm_base_scores}
ORACLE_SQL = {
    "lm_base_scores": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {SQL_CRC32.format("coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held_out,
         {SQL_WORDS.format(SQL_LOWER.format("coalesce(text, '')"))} || [''] AS ws
  FROM documents),
w AS (SELECT r, held_out, unnest(ws) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 1) / (n.n + n.v + 1))), 3) AS base_score
FROM d JOIN w USING (r) LEFT JOIN c USING (word), n GROUP BY r"""
}
