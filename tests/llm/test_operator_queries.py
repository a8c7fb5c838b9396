"""The registered queries: those with SQL against DuckDB, the others and the pipeline against plain Python."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillrow.llm import licenses, mixing, packing, quality
from quillrow.llm.common import materialize, table
from quillrow.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.fixture(scope="module")
def found(spark):
    """Each query's rows, computed once."""
    kept = {}

    def rows(name):
        if name not in kept:
            kept[name] = [r.asDict(recursive=True) for r in QUERIES[name](spark, DATA).collect()]
        return kept[name]

    return rows


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()


def _shown(row, names):
    return tuple(repr(round(v, 6) if isinstance(v := row[n], float) else v) for n in names)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(duck, found, name):
    rows, relation = found(name), duck.sql(ORACLE_SQL[name])
    names = sorted(relation.columns)
    assert sorted(rows[0]) == names
    assert Counter(_shown(r, names) for r in rows) == Counter(_shown(dict(zip(relation.columns, r, strict=True)), names) for r in relation.fetchall())


def test_op1(found, documents):
    rows = {r["doc_id"]: r for r in found("op1_lm_scoring")}
    assert len(rows) == len(documents)
    for i, text, *_ in documents:
        r, n = rows[i], len(WORDS.findall(text or "")) + 1
        assert r["n_tokens"] == n and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0
        assert abs(r["perplexity"] / 10 ** (-r["score"] / n) - 1) < 1e-9
    seen = [r for r in rows.values() if not r["held_out"]]
    assert sum(r["score"] for r in seen) > 0.8 * sum(r["base_score"] for r in seen)


def test_op3(found, documents):
    rows = {r["doc_id"]: r for r in found("op3_language_id")}
    assert len(rows) == len(documents)
    held = [(rows[i]["lang_pred"], lang) for i, _, lang, _ in documents if zlib.crc32(str(i).encode()) % 4 == 2 and lang]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows.values())


def test_op4(found, documents):
    rows = {r["doc_id"]: r for r in found("op4_quality_rules")}
    assert len(rows) == len(documents) and all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in rows.values())


def test_op5(found, documents):
    rows = found("op5_near_dedup")
    classes = defaultdict(list)
    for r in rows:
        classes[r["class_id"]].append(r)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in documents)
    assert all(min(r["doc_id"] for r in c) == k and {r["class_size"] for r in c} == {len(c)} and sum(r["kept"] for r in c) == 1 for k, c in classes.items())
    of, words = {r["doc_id"]: r["class_id"] for r in rows}, {i: tuple((t or "").encode().split()) for i, t, *_ in documents}
    first = {}
    for i, w in words.items():
        assert of[first.setdefault(w, i)] == of[i]


def test_op6(found, documents):
    tokenizer, pieces = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for i, text, *_ in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces.update((i, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096))
    rows = found("op6_packing")
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == pieces
    _sequences_are_gapless(rows)


def _sequences_are_gapless(rows):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len(sequences) <= sum(r["length"] for r in rows) / 4096 * 1.05 + 2


def test_op8(found, documents):
    rows = {r["doc_id"]: r for r in found("op8_license_scan")}
    assert len(rows) == len(documents) and all(0 <= r["score"] <= 1 for r in rows.values())
    for i, text, *_ in documents:
        said = f" {' '.join(re.findall('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', (text or '').translate({k: k + 32 for k in range(65, 91)})))} "
        own = {label for label, (_, keys) in licenses.NOTICES.items() if all(f" {k} " in said for k in keys)}
        assert set(rows[i]["labels"].split(",")) - {""} <= own | set(rows[i]["base_labels"].split(",")) and set(rows[i]["base_labels"].split(",")) <= set(rows[i]["labels"].split(","))


# -- the pipeline -------------------------------------------------------------------------------


def _quality_kept(rows, rules):
    out = []
    for i, text, lang, source in rows:
        w = WORDS.findall(text or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k for a in range(len(w) - 7) if windows[tuple(w[a : a + 8])] > 1 for k in range(a, a + 8)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        n, count = len(w), lambda pattern, text=text: len(re.findall(pattern, text or ""))
        value = {
            "n_words": n,
            "mean_word": sum(map(len, w)) / max(n, 1),
            "symbols": count(r"[#*$%&|<>]") / max(n, 1),
            "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
            "repeats": len(repeated) / max(n, 1),
            "distinct": len(set(w)) / max(n, 1),
            "stops": count(r"[.,;:!?]") / max(n, 1),
            "capitals": count("[A-Z]") / max(n, 1),
            "digits": count("[0-9]") / max(n, 1),
        }
        bad = any(all(value[name] <= t if at_most else value[name] > t for name, at_most, t in rule.conditions) for rule in rules)
        if n >= 20 and 100 * len(repeated) <= 30 * n and not bad:
            out.append((i, text, lang, source))
    return out


def test_pipeline(spark, duck, tmp_path):
    """Each stage on what the one before has kept, against plain Python (DuckDB for the mix)."""
    from test_documents import _brute_classes

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = table(spark, DATA, "documents")
    kept = lambda df: sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())
    said = kept(docs)

    rules = quality.learn(quality.statistics(docs), table(spark, DATA, "labels"))
    docs = materialize(stages["quality rules"](spark, docs, DATA))
    said = sorted(_quality_kept(said, rules))
    assert kept(docs) == said and docs.columns == table(spark, DATA, "documents").columns

    docs = materialize(stages["exact dedup"](spark, docs, DATA))
    best = {}
    for row in said:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", row[1]).encode()).digest()
        best[key] = min(best.get(key, row), row, key=lambda r: (-len(r[1]), r[0]))
    said = sorted(best.values())
    assert kept(docs) == said

    docs = materialize(stages["near dedup"](spark, docs, DATA))
    first = {c[0] for c in _brute_classes(said)}
    said = [r for r in said if r[0] in first]
    assert kept(docs) == said

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    duck.sql(f"CREATE OR REPLACE TEMP VIEW kept AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    taken = duck.sql(f"SELECT doc_id, taken FROM ({mixing.ORACLE_SQL['op10_mixing'].replace('FROM documents', 'FROM kept')})").fetchall()
    docs = materialize(stages["mixing"](spark, docs, DATA))
    words, texts = Counter(), {r[0]: WORDS.findall(r[1]) for r in said}
    for i, text, *_ in kept(docs):
        own = WORDS.findall(text)
        words[i] += len(own)
        assert own and any(texts[i][k : k + len(own)] == own for k in range(len(texts[i]) - len(own) + 1))
    assert words == Counter({i: n for i, n in taken if n})

    tokenizer, pieces = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for i, text, *_ in kept(docs):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        pieces.update((i, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096))
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == pieces
    _sequences_are_gapless(rows)


def test_pipeline_without_rows(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, DATA, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_awkward_rows(spark, awkward, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    labels = awkward.filter("doc_id is not null").select("doc_id", (F.length(F.coalesce("text", F.lit(""))) > 30).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and len({r["sequence_id"] for r in rows}) >= 1
    _sequences_are_gapless(rows)
