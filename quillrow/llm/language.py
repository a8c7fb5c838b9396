"""Language identification by hierarchical discrimination.

A text is first given to a language family, then to a language of that family, both times by
one-versus-one linear support vector machines over hashed byte n-grams of the whole text. Family
machines see all languages; machines inside a family only separate its close relatives.

The machines are fitted in tasks from a bounded sample: at most ``PER_LANGUAGE`` labelled distinct
training texts of each language, the first by a hash, each as a sparse vector of ``DIMENSIONS``
numbers. Classes are taken in blocks, and a task fits the machines of two blocks, so no task holds
more than 2 * BLOCK classes. Only the machines, at most MOST_LANGUAGES ** 2 / 2 of 8 kB, reach the
driver and are broadcast; tables with more languages are refused. Prediction reads every whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text if
nothing was learned; with one learned language all others are that language. Null languages are
never learned. Repeated rows are predicted each; an empty table gives an empty result. Other
columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrow.llm.common import checkpoint, ship, table

DIMENSIONS = 4096
PER_LANGUAGE = 400
#: Languages that one model tells apart; more are refused, none is left out.
MOST_LANGUAGES = 150
#: Classes in a block.
BLOCK = 8

# ISO 639-1 codes by family. Any other value is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "indo-aryan": "hi bn ur mr ne pa gu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(),
}


def family(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language.lower().split("-")[0] in codes), language)


#: ASCII other than letters counts as white space.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


#: For the JVM: a letter, or a character too new for it to know, which has_letter() then judges.
LETTER = r"[\p{L}\p{Cn}]"


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of the counts of hashed byte 2-, 3- and 4-grams, scaled to length 1."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" ", dtype=np.uint8).astype(np.uint32)
    code, counts = b, np.zeros(dimensions)
    for n in (2, 3, 4):
        if len(b) < n:
            break
        code = code[:-1] * np.uint32(256) + b[n - 1 :]
        slot = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
        counts += np.bincount(slot % np.uint32(dimensions), minlength=dimensions)
    counts = np.sqrt(counts)
    return (counts / max(1e-12, np.linalg.norm(counts))).astype(np.float32)


def packed(x: np.ndarray) -> bytes:
    """A vector without its zeros: places, then numbers."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpacked(data: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    n, out = len(data) // 6, np.zeros(dimensions, np.float32)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return out


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """A linear support vector machine (y is -1 or 1): averaged subgradient steps on the hinge loss, classes weighed alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * y
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    w, mean = np.zeros(x1.shape[1], np.float32), np.zeros(x1.shape[1])
    for t in range(1, steps + 1):
        inside = y * (x1 @ w) < 1
        w = (1 - 1 / t) * w + ((weight * inside).astype(np.float32) @ x1) / np.float32(strength * t)
        if t > steps // 2:
            mean += w / (steps - steps // 2)
    return mean[:-1].astype(np.float32), float(mean[-1])


@dataclass
class OneVersusOne:
    """A machine for each pair of classes; the class with the most votes wins, ties go to the larger margins."""

    classes: list[str]
    weights: np.ndarray | None = None
    biases: np.ndarray | None = None

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        """The class and how sure it is: a logistic of its smallest margin."""
        if self.weights is None:
            return self.classes[0], 1.0
        margins = self.weights @ x + self.biases
        n = len(self.classes)
        of = np.full((n, n), np.inf)
        a, b = np.triu_indices(n, 1)
        of[a, b], of[b, a] = margins, -margins
        votes = (of > 0).sum(axis=1) - 1
        best = max(range(n), key=lambda c: (votes[c], np.tanh(of[c]).sum(), -c))
        return self.classes[best], float(1 / (1 + np.exp(-3 * of[best].min())))


@dataclass
class Model:
    families: OneVersusOne | None = None
    languages: dict[str, OneVersusOne] | None = None

    def predict(self, text: str | None) -> tuple[str, str | None, float]:
        """(language, family, score)."""
        if self.families is None or not has_letter(text):
            return "und", None, 0.0
        x = vector(text)
        group, sure = self.families.choose(x)
        language, surer = self.languages[group].choose(x)
        return language, group, sure * surer


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        vectors = [packed(vector(t)) if has_letter(t) else None for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(vectors, pa.binary())], ["lang", "hash", "vector"])


def _fitted(t: pa.Table) -> pa.Table:
    """The machines of all pairs of one class of block a and one of block b."""
    group, a, b = (t.column(k)[0].as_py() for k in ("group", "a", "b"))
    of: dict[int, list[np.ndarray]] = {}
    order = t.sort_by([("class", "ascending"), ("lang", "ascending"), ("hash", "ascending")])
    for c, data in zip(order.column("class").to_pylist(), order.column("vector").to_pylist(), strict=True):
        of.setdefault(c, []).append(unpacked(data))
    x = {c: np.stack(v) for c, v in of.items()}
    pairs = [(c, d) for c in sorted(x) for d in sorted(x) if c < d and (c // BLOCK, d // BLOCK) == (a, b)]
    machines = [svm(np.concatenate((x[c], x[d])), np.repeat([1.0, -1.0], [len(x[c]), len(x[d])])) for c, d in pairs]
    return pa.table(
        {
            "group": pa.array([group] * len(pairs), pa.string()),
            "first": pa.array([c for c, _ in pairs], pa.int32()),
            "second": pa.array([d for _, d in pairs], pa.int32()),
            "weights": pa.array([w.astype("<f2").tobytes() for w, _ in machines], pa.binary()),
            "bias": pa.array([bias for _, bias in machines], pa.float64()),
        }
    )


def sampled(rows: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, hash, vector): the first per_language distinct texts of each language by their hash."""
    ship()
    rows = rows.filter("lang is not null and text is not null").withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    # Copies and texts that has_letter() may refuse do not count as examples.
    usable = F.when(F.col("text").rlike(LETTER), F.col("hash"))
    counts = rows.groupBy("lang").agg(F.count_distinct(usable).alias("distinct")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    whole = F.lit(1 << 40)
    reach = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], int((1 << 40) * min(1.0, 1.5 * per_language / max(1, r["distinct"])))))) if counts else F.create_map(F.lit(""), whole)
    sample = rows.filter((F.col("hash") < reach[F.col("lang")]) & F.col("text").rlike(LETTER)).dropDuplicates(["lang", "hash"]).select("lang", "hash", "text")
    got = sample.mapInArrow(_vectors, "lang string, hash long, vector binary").filter("vector is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    return got.withColumn("place", place).filter(F.col("place") <= per_language).drop("place")


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on rows (text, lang): at most per_language documents of each language."""
    sample = checkpoint(sampled(rows, per_language))
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # at most MOST_LANGUAGES
    if not languages:
        return Model()
    families = sorted({family(s) for s in languages})
    groups = {"": families} | {f"of {f}": [s for s in languages if family(s) == f] for f in families}
    places = []
    for s in languages:
        for group, name in (("", family(s)), (f"of {family(s)}", s)):
            c = groups[group].index(name)
            for other in range(-(-len(groups[group]) // BLOCK)):
                places.append((s, group, c, *sorted((c // BLOCK, other))))
    places = F.broadcast(rows.sparkSession.createDataFrame(places, "lang string, group string, class int, a int, b int"))  # under MOST_LANGUAGES ** 2 rows
    machines = sample.join(places, "lang").groupBy("group", "a", "b").applyInArrow(_fitted, "group string, first int, second int, weights binary, bias double")
    found = {(r["group"], r["first"], r["second"]): r for r in machines.collect()}

    def one_versus_one(group: str) -> OneVersusOne:
        classes = groups[group]
        own = [found[group, c, d] for c, d in combinations(range(len(classes)), 2)]
        if not own:
            return OneVersusOne(classes)
        return OneVersusOne(classes, np.stack([np.frombuffer(r["weights"], "<f2").astype(np.float32) for r in own]), np.array([r["bias"] for r in own]))

    return Model(one_versus_one(""), {f: one_versus_one(f"of {f}") for f in families})


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.value.predict
        for batch in batches:
            said = [predict(t) for t in batch.column("text").to_pylist()]
            languages, groups, scores = zip(*said, strict=True) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(groups, pa.string())],
                ["doc_id", "held_out", "lang_pred", "score", "family"],
            )

    return run


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, family. Learns from the documents that are not held out."""
    ship()
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.withColumn("held_out", held_out)
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.filter(~F.col("held_out")).select("text", "lang")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predicted(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, family string")


def op3_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
