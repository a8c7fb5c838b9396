"""Each operator on awkward rows and on none, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrow.llm import chat, exact_dedup, language, licenses, lm_score, mixing, near_dedup, packing, quality, sharding
from quillrow.llm import components as component_module
from quillrow.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


# -- exact dedup --------------------------------------------------------------------------------


@pytest.mark.parametrize("bits, most", [(64, 1_000_000), (3, 1_000_000), (3, 0)])
def test_exact_groups(awkward, awkward_rows, bits, most, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_COLLIDED", most)
    found = exact_dedup.exact_groups(awkward, hash_bits=bits).collect()
    groups = defaultdict(list)
    for i, t, *_ in awkward_rows:
        groups[bare(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    assert Counter((r["doc_id"], r["text_sha256"]) for r in found) == Counter((i, hashlib.sha256(bare(t).encode()).hexdigest()) for i, t, *_ in awkward_rows)
    for text, members in groups.items():
        mine = [r for r in found if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert {r["group_size"] for r in mine} == {len(members)} and {r["keep_id"] for r in mine} == {min(members)[3]}
        assert sum(r["kept"] for r in mine) == 1


def test_chunks_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (0, 1, 500, 40_000, 9_000)]
    together = exact_dedup.chunk_ends(texts)
    assert together == [exact_dedup.chunk_ends([t])[0] for t in texts]
    assert all(e[-1] == len(t) and all(b - a <= exact_dedup.MOST for a, b in zip([0, *e], e, strict=False)) for e, t in zip(together, texts, strict=True))
    shifted = exact_dedup.chunk_ends([b"prefix" + texts[3]])[0]
    assert len({e - 6 for e in shifted} & set(together[3])) > 5


def test_exact_dedup_keeps_columns(awkward, awkward_rows):
    kept = exact_dedup.exact_dedup(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({bare(t) for _, t, *_ in awkward_rows})


def test_ties_are_settled_by_the_rows(spark):
    """Rows alike but for other columns: reruns over any partitions keep the same ones."""
    rows = [(k % 3, f"text {k % 2}" + " and some more words to count" * 20, "s", {"a": k}, [k], float(k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, l array<int>, x double")
    for stage in (exact_dedup.exact_dedup, near_dedup.near_dedup, lambda d: mixing.mix_documents(d, block=8, weights=(1,))):
        shown = [sorted(map(repr, stage(docs.repartition(n, order)).collect())) for n, order in ((1, "x"), (5, "doc_id"), (4, "text"))]
        assert shown[0] == shown[1] == shown[2] and shown[0]


# -- near dedup ---------------------------------------------------------------------------------


def _edited(words, rng, n):
    """n words replaced, left out, or put in."""
    out = list(words)
    for k in sorted(rng.choice(len(out), n, replace=False), reverse=True):
        kind = rng.integers(0, 3)
        out[k : k + (kind != 2)] = [] if kind == 1 else [f"edit{k}"]
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        for edits in (0, 0, 1, 2, 3, 8, 60):
            rows.append((at, " ".join(_edited(words, rng, edits)), "en", "a"))
            at += 1
    chain = [f"c{k}" for k in range(300)]
    for k in range(12):  # each close to the next, the ends far apart
        rows.append((at + k, " ".join(chain[: 300 - 18 * k] + [f"d{j}" for j in range(18 * k)]), "en", "a"))
    return rows


def _aligned_words(a, b):
    """Longest common subsequence by increasing runs of matching places: no code of the operator's."""
    from bisect import bisect_left

    places, ends = defaultdict(list), []
    for j, y in enumerate(b):
        places[y].append(j)
    for x in a:
        for j in reversed(places[x]):
            k = bisect_left(ends, j)
            ends[k : k + 1] = [j]
    return len(ends)


def _brute_classes(rows):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n, m = len(texts[a]), len(texts[b])
            if min(n, m) < 0.8 * max(n, m):
                continue
            if texts[a] == texts[b] or min(n, m) >= 5 and (same := _aligned_words(texts[a], texts[b])) >= 0.8 * (n + m - same):
                parent[top(a)] = top(b)
    classes = defaultdict(list)
    for k in range(len(rows)):
        classes[top(k)].append(rows[k][0])
    return sorted((sorted((x for x in c if x is not None)) + [None] * c.count(None) for c in classes.values()), key=repr)


def _found_classes(found):
    classes = defaultdict(list)
    for r in found:
        classes[r["class_id"]].append(r["doc_id"])
    return sorted(map(sorted, classes.values()), key=repr)


@pytest.mark.parametrize("which", ["near", "awkward"])
def test_near_classes(make, awkward, awkward_rows, near_rows, which):
    rows, docs = (near_rows, make(near_rows)) if which == "near" else (awkward_rows, awkward)
    found = near_dedup.near_classes(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in rows)
    expected = _brute_classes(rows)
    if which == "near":
        assert _found_classes(found) == expected
        assert all(r["class_id"] <= r["doc_id"] for r in found) and sum(r["kept"] for r in found) == len(expected)
    else:
        assert Counter(r["class_size"] for r in found) == Counter(len(c) for c in expected for _ in c)


def test_near_copies_by_length_and_edits():
    """Planted edits: candidates by the sketch, and links by the alignment, for at least nine in ten."""
    rng, hashes, seeds = np.random.default_rng(21), near_dedup._WordHashes(), near_dedup._seeds()
    for length, edits in ((20, 1), (40, 1), (40, 3), (80, 2), (80, 6), (200, 6), (200, 16), (1000, 30)):
        linked = 0
        for _ in range(60):
            words = [f"w{k}" for k in rng.integers(0, 5000, length)]
            a, b = (near_dedup.Text(" ".join(w), hashes) for w in (words, _edited(words, rng, edits)))
            met = (near_dedup.sketch(a.shingles, seeds) == near_dedup.sketch(b.shingles, seeds)).any()
            linked += met and a.similarity(b, 0.8) >= 0.8
        assert linked >= 54, (length, edits, linked)


def test_a_passage_that_many_texts_share(make, monkeypatch):
    """Unlike texts around one passage are dealt out again without it; the near copies among them are found."""
    rng = np.random.default_rng(22)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = [f"w{k}" for k in rng.integers(0, 9000, 60)]
        rows.append((i, " ".join(own[:30] + passage + own[30:]), "en", "a"))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(_edited(own[:30] + passage + own[30:], rng, 5)), "en", "a"))
        if i % 25 == 0:  # nearly nothing beside the passage
            rows += [(2000 + i + k, " ".join(passage + [f"x{i}", f"y{k}"]), "en", "a") for k in range(2)]
    expected, again = _brute_classes(rows), []
    monkeypatch.setattr(near_dedup, "LARGE", 6)
    remainder = near_dedup._remainder
    monkeypatch.setattr(near_dedup, "_remainder", lambda *a: again.append(remainder(*a)) or again[-1])
    assert _found_classes(near_dedup.near_classes(make(rows)).collect()) == expected
    assert len(again) > 1 and again[0][1].count() > 0


def test_clashing_names_of_texts(make, near_rows, monkeypatch):
    class Narrow:
        xxh3_64_intdigest = staticmethod(near_dedup.xxhash.xxh3_64_intdigest)

        @staticmethod
        def xxh3_128_digest(data):  # eight names for all texts
            whole = hashlib.sha256(data).digest()
            return bytes(7) + bytes([whole[0] % 8]) + whole[8:16]

    monkeypatch.setattr(near_dedup, "xxhash", Narrow)
    assert _found_classes(near_dedup.near_classes(make(near_rows)).collect()) == _brute_classes(near_rows)


def test_few_rows_take_few_tasks(make, near_rows, spark):
    """What a step leaves of few rows is read by few tasks, however many partitions a shuffle has: the driver keeps the books of each."""
    held, context = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, spark.sparkContext
    before = {k: spark.conf.get(k) for k in held}
    docs = make(near_rows).cache()
    docs.count()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few tasks", "")
        found = near_dedup.near_classes(docs).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
        docs.unpersist()
    assert _found_classes(found) == _brute_classes(near_rows)
    jobs = map(context.statusTracker().getJobInfo, context.statusTracker().getJobIdsForGroup("few tasks"))
    stages = [context.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert 0 < tasks < 46 * 24, tasks


def test_small_blocks_find_the_same(make, near_rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    found = near_dedup.near_classes(make(near_rows)).select("class_id").distinct().count()
    assert found == len(_brute_classes(near_rows))


@pytest.mark.parametrize("links", [200_000, 50])
def test_components_against_brute_force(spark, monkeypatch, links):
    monkeypatch.setattr(component_module, "TASK_LINKS", links)
    rng = np.random.default_rng(30)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(k, 2000 + k % 7) for k in range(2100, 2400)] + [(7, 7), (3000, 3000)]
    pairs += [(int(a), 2000 + int(b)) for a, b in zip(rng.integers(2100, 2400, 40), rng.integers(0, 3, 40), strict=True)] + [(5000, k) for k in range(5001, 5040)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    while any(label[a] != label[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    groups = lambda of: sorted(sorted(x for x in of if of[x] == c) for c in set(of.values()))
    again = pairs + [(b, a) for a, b in pairs[:100]] + pairs[:50]
    found = components(spark.createDataFrame(again, "a long, b long")).collect()
    assert len(found) == len(label) and groups({r["node"]: r["component"] for r in found}) == groups(label)
    assert all(label[r["component"]] == label[r["node"]] for r in found)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_alignment_against_a_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
        b = a.copy() if rng.random() < 0.3 else np.delete(np.insert(a, rng.integers(0, len(a) + 1), 9), rng.integers(0, len(a)))
        n, m = len(a), len(b)
        table = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        true = table[n, m]
        found = near_dedup.aligned(a, b, 0.6)
        assert found <= true and (found == true or true / (n + m - true) < 0.6)


def test_sketch_in_slices(monkeypatch):
    s = np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64)
    whole = near_dedup.sketch(s, near_dedup._seeds())
    monkeypatch.setattr(near_dedup, "SLICE", 700)
    assert (near_dedup.sketch(s, near_dedup._seeds()) == whole).all()


def test_near_dedup_keeps_columns(awkward, awkward_rows):
    kept = near_dedup.near_dedup(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len(_brute_classes(awkward_rows))


# -- quality ------------------------------------------------------------------------------------


def _counts(text):
    w = WORDS.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(make, awkward_rows):
    extra = [(200, "a b c d e f g h i\n" * 3 + "z", "en", "a"), (201, "x\n\nx\nx y\n#$%", "en", "a"), (202, "k " * 40 + "l " * 40, "en", "a")]
    rows = awkward_rows + extra
    found = quality.statistics(make(rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in found) == Counter((i, *_counts(t)) for i, t, *_ in rows)


def test_quality_learns_rules(spark, make):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(words, 60))
        if i % 3 == 0:
            text = " ".join(x + "###" for x in text.split()) if i % 2 else " ".join(rng.choice(words[:4], 60))
        rows.append((i, text, "en", "a"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0) if i % 50 else None, 0) for i in range(400)] + [(10_000, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make(rows)
    found = quality.quality_rules(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in found)
    assert {r["doc_id"] for r in quality.quality_filter(docs, labels).collect()} == {i for i in range(600) if i % 3}
    assert quality.quality_filter(docs, labels).columns == docs.columns
    assert quality.learn(quality.statistics(docs), labels.limit(0)) == []


def _brute_rules(rows, cuts):
    """Sequential covering over (features, bad, held), trying every condition on every row."""
    rules, left = [], rows
    holds = lambda c, f: all((f[n] <= t) == at_most for n, at_most, t in c)
    names = list(quality.FEATURES)
    while len(rules) < quality.MOST_RULES:
        grown = []
        while len(grown) < quality.MOST_CONDITIONS:
            inside = [(f, bad) for f, bad, held in left if not held and holds(grown, f)]
            p0, n0 = sum(b for _, b in inside), sum(not b for _, b in inside)
            best, choice = 1e-9, None
            if p0 and n0:
                for name in names:
                    for t in cuts[name]:
                        for at_most in (True, False):
                            p = sum(b for f, b in inside if (f[name] <= t) == at_most)
                            n = sum(not b for f, b in inside if (f[name] <= t) == at_most)
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                            if gain > best * (1 + 1e-12):
                                best, choice = gain, (name, at_most, t)
            if choice is None:
                break
            grown.append(choice)
        if not grown:
            break
        worth = []
        for k in range(1, len(grown) + 1):
            there = [bad for f, bad, held in left if held and holds(grown[:k], f)]
            p, n = sum(there), len(there) - sum(there)
            worth.append(((p - n) / max(1, p + n), p, -k, n))
        _, p, k, n = max(worth)
        k = -k
        if p < quality.SUPPORT or p < quality.PRECISION * (p + n):
            break
        rules.append(grown[:k])
        left = [x for x in left if not holds(grown[:k], x[0])]
    return rules


def test_quality_rules_against_brute_force(spark, make):
    rng = np.random.default_rng(34)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(900):
        own = list(rng.choice(words, int(rng.integers(15, 70))))
        if i % 4 == 0:
            own = [x + "#" * int(rng.integers(1, 3)) if rng.random() < 0.4 else x for x in own]
        elif i % 7 == 0:
            own = [str(rng.choice(words[:5])) for _ in own]
        rows.append((i, " ".join(own) + ("." if rng.random() < 0.5 else ""), "en", "a"))
    bad = {i: (i % 4 == 0 or i % 7 == 0) != (rng.random() < 0.01) for i in range(900)}
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    counts = quality.statistics(make(rows)).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).select("doc_id", "held", *(e(F.col).alias(f"f_{c}") for c, e in quality.FEATURES.items()))
    told = [({c: r[f"f_{c}"] for c in quality.FEATURES}, bad[r["doc_id"]], r["held"]) for r in counts.collect()]
    cuts = counts.select(*(F.percentile_approx(f"f_{c}", [i / quality.BINS for i in range(1, quality.BINS)], 2000).alias(c) for c in quality.FEATURES)).first()
    expected = _brute_rules(told, {c: sorted(set(cuts[c])) for c in quality.FEATURES})
    found = [r.conditions for r in quality.learn(quality.statistics(make(rows)), labels)]
    assert found == [[tuple(c) for c in r] for r in expected] and len(found) >= 2


# -- mixing -------------------------------------------------------------------------------------


def test_targets_and_seats():
    assert mixing.capped_targets([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    capped = mixing.capped_targets([10, 1000, 1000], [5, 2, 1], 3)
    assert capped[0] == 30 and math.isclose(sum(capped), 2010) and math.isclose(capped[1], 2 * capped[2])
    rng = np.random.default_rng(1)
    for _ in range(100):
        w, seats = (rng.integers(0, 1000, rng.integers(1, 9)) + 0.5).tolist(), int(rng.integers(0, 60))
        given = [0] * len(w)
        for _ in range(seats):
            given[max(range(len(w)), key=lambda k: (w[k] / (2 * given[k] + 1), -k))] += 1
        assert mixing.sainte_lague(w, seats) == given


def test_mix(awkward, awkward_rows):
    found = mixing.mix(awkward, block=4, shard_words=5000).collect()
    again = mixing.mix(awkward.repartition(2), block=4, shard_words=5000).collect()
    shown = lambda rows: Counter((r["doc_id"], r["size"], r["source"], r["taken"]) for r in rows)
    assert shown(found) == shown(again) and len(found) == len(awkward_rows)
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(WORDS.findall(t or ""))) for i, t, *_ in awkward_rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    by = defaultdict(int)
    for r in found:
        by[r["source"], r["target"], r["source_size"]] += r["taken"]
    assert {s for s, *_ in by} == {r[3] for r in awkward_rows}
    assert all(abs(taken - target) <= 60 for (_, target, _), taken in by.items())


def test_mixed_documents_hold_what_is_taken(awkward):
    plan = mixing.mix(awkward, block=4, shard_words=5000).agg(F.sum("taken")).first()[0]
    out = mixing.mix_documents(awkward, block=4, shard_words=5000)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert sum(len(WORDS.findall(r["text"])) for r in rows) == plan and all(r["n_chars"] == len(r["text"]) for r in rows)


# -- packing ------------------------------------------------------------------------------------


def test_packing(awkward, awkward_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in awkward_rows]
    rows = packing.pack(awkward).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    expected = Counter((i, a, min(4096, len(x) - a), crc(x[a : a + 4096]), len(x)) for i, x in ids for a in range(0, len(x), 4096))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    model = open(packing.tokenizer_path(), encoding="utf-8").read()
    tokenizer, ids = Tokenizer.from_str(model), packing._Ids(model)
    rng = np.random.default_rng(8)
    pool = list("abcXYZ'sdtreÀÉßÿĀİıΣςſK½²́̀.,;:!?<>|-_ \t\n\x0b\x0c\r\x1c\x85\xa0　漢字🙂0123")
    texts = ["".join(rng.choice(pool, rng.integers(0, 50))) for _ in range(3000)] + ["<|endoftext|>a b<|startoftext|>", "I'LL don't, we'RE! ÀB. é. É,"]
    for text, found in zip(texts, ids.texts(texts), strict=True):
        assert found == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_column_generation_is_tight():
    rng = np.random.default_rng(6)
    histogram = {int(k): int(v) for k, v in zip(range(1, 101), rng.integers(0, 400, 100), strict=True) if v}
    patterns = packing.plan(histogram, 256)
    used = Counter()
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 256
        for k, n in pattern.items():
            used[k] += n * times
    assert used == histogram
    sequences = sum(t for _, t in patterns)
    assert sequences <= 1.005 * sum(k * n for k, n in histogram.items()) / 256 + 2
    assert packing.plan({}, 256) == []


def test_long_programs_end_beside_spark(spark, monkeypatch):
    """Hundreds of pricing steps, with new inverses, in a process that runs Spark and the tokenizer."""
    import threading

    from tokenizers import Tokenizer

    a = np.random.default_rng(1).normal(size=(40, 40))
    assert np.allclose((a[:, :, None] * packing._inverse(a)[None]).sum(axis=1), np.eye(40))
    assert spark.range(1000).selectExpr("sum(id)").first()[0] == 499_500
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    assert len(tokenizer.encode_batch(["some words"] * 1000)) == 1000
    steps, price, inverses, inverse = [], packing._best_pattern, [], packing._inverse
    monkeypatch.setattr(packing, "_greedy", lambda *a: [])
    monkeypatch.setattr(packing, "_best_pattern", lambda *a: steps.append(1) or price(*a))
    monkeypatch.setattr(packing, "_inverse", lambda x: inverses.append(1) or inverse(x))
    demand = np.random.default_rng(4).integers(1, 5000, 256).astype(float)
    out = []
    thread = threading.Thread(target=lambda: out.append(packing.solve(np.arange(1, 257), demand, 1009, gap=0.0, rounds=450)), daemon=True)
    thread.start()
    thread.join(180)
    assert not thread.is_alive() and len(steps) > 300 and len(inverses) > 2
    basis, used = out[0]
    assert np.allclose((basis * used).sum(axis=1), demand) and (used >= 0).all()


# -- sharding -----------------------------------------------------------------------------------


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    owner = sharding.fill(names, 997)
    brute, turn = [None] * 997, 0
    orders = [iter([(o + k * s) % 997 for k in range(997)]) for o, s in (sharding.preference(n, 997) for n in names)]
    while None in brute:
        slot = next(x for x in orders[turn % 7] if brute[x] is None)
        brute[slot] = turn % 7
        turn += 1
    assert owner == brute and max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = sharding.fill(names[:-1], 997)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 0.12 * 997
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_place(spark, awkward, awkward_rows, tmp_path):
    placed = sharding.place(awkward, "doc_id", ["x", "y", "z"], 101)
    assert placed.columns == [f"given_{c}" if c in ("slot", "shard") else c for c in awkward.columns] + ["slot", "shard"]
    owner = sharding.fill(["x", "y", "z"], 101)
    slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 101
    rows = placed.select("doc_id", "slot", "shard", "given_slot", "given_shard").collect()
    assert all(r["given_slot"] == "slot!" and r["given_shard"] == "shard!" for r in rows)
    assert len(rows) == len(awkward_rows) and all(r["slot"] == slot(r["doc_id"]) and r["shard"] == owner[r["slot"]] for r in rows)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(awkward_rows)


# -- licences -----------------------------------------------------------------------------------


def test_license_scan(make, awkward_rows):
    mit = "/* Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software */"
    extra = [
        (200, "Under the MIT license. under-the-mit license; CC BY-NC 4.0, Apache License, Version 2.0", "en", "a"),
        (201, "x " * 50 + mit, "en", "a"),
        (202, "This work is licensed under the GNU General Public License, version 3.", "en", "a"),
        (203, "permission hereby charge person software obtaining documentation associated", "en", "a"),
        (204, "under the mit under the mit license", "en", "a"),
    ]
    rows = awkward_rows + extra
    found = licenses.scan(make(rows)).collect()
    expected = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        expected[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == expected
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in found if (r["doc_id"] or 0) >= 200}
    assert labels[200][0] == "apache-2,cc-by-nc,mit" and labels[201][0] == "mit" and labels[202] == ("gpl-3", 1.0)
    assert labels[203][0] == "" and labels[204][0] == "mit" and all(0 <= r["score"] <= 1 for r in found)


def test_bundle_of_all_notices(make, awkward_rows):
    """A file may hold every notice; none is lost to the number of licence words."""
    whole = " x ".join(notice for notice, _ in licenses.NOTICES.values())
    idf = licenses.rarity(make(awkward_rows))
    common = dict.fromkeys(idf, 1.0) | {w: 9.0 for label in ("mit", "bsd-3", "isc") for w in licenses.NOTICES[label][0].split()}
    for weights in (idf, common):
        found = {r["doc_id"]: r for r in licenses.scan(make([(1, whole, "en", "a"), (2, "z " * 500 + whole, "en", "a")]), weights).collect()}
        for i in (1, 2):
            assert set(found[i]["labels"].split(",")) >= set(licenses.NOTICES) and found[i]["score"] == 1.0


def test_numbered_notice(make, awkward_rows):
    """A number before a clause is a word, and does not part the notice's postings."""
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    rare = "redistribution redistributions disclaimer retain binary modification permitted copyright".split()
    idf = dict.fromkeys(licenses.template_words(), 1.0) | dict.fromkeys(rare, 9.0)
    twice = "copyright x copyright x x copyright x x permitted " * 50
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(make([(1, text, "en", "a"), (2, twice, "en", "a")]), idf).collect()}
    assert found[1] == ("bsd-3", 1.0) and found[2][0] == "" and found[2][1] <= 0.5


def _brute_labels(text, idf):
    """Own labels and score of a text, by trying every beginning of every notice."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    labels, best = set(), 0.0
    for label, (notice, keys) in licenses.NOTICES.items():
        said = notice.split()
        rare = sorted(set(said), key=lambda x: (-idf[x], x))[: licenses.RARE]
        postings = [(p, word) for p, word in enumerate(said) if word in rare]
        begins = [(i - p, k) for k, (p, word) in enumerate(postings) for i, x in enumerate(w) if x == word]
        most = max((len({k for c, k in begins if b - licenses.SLACK <= c <= b}) for b, _ in begins), default=0)
        share = most / len(postings)
        sure = share >= licenses.ALIGNED and all(f" {k} " in f" {' '.join(w)} " for k in keys)
        labels |= {label} if sure else set()
        best = max(best, share if sure else share / 2)
    phrases = [(p.split(), label) for p, label in licenses.PHRASES.items()]
    base = {label for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p}
    return ",".join(sorted(labels | base)), 1.0 if base else best


def test_own_labels_against_brute_force(make, awkward_rows):
    """Each notice alone, in pairs, cut short, with words left out or put in, and lower case of A-Z alone."""
    rng = np.random.default_rng(12)
    whole = [notice for notice, _ in licenses.NOTICES.values()]
    assert len(whole) >= 30 and all(k in notice for notice, keys in licenses.NOTICES.values() for k in keys)
    texts = [n.title() for n in whole] + [f"{rng.choice(whole)} {rng.choice(whole)}" for _ in range(20)]
    for n in whole:
        said = n.split()
        texts += [" ".join(said[: len(said) // 2]), " ".join(x for x in said if rng.random() < 0.85), " ".join(x + (" 1" if rng.random() < 0.1 else "") for x in said)]
    texts += ["\u212aeep this work is licensed under the gnu general public license version 3", "\u212adirect wor\u212a"]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    idf = licenses.rarity(make(rows + awkward_rows[:40]))
    found = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(make(rows), idf).collect()}
    expected = {k: (labels, round(score, 9)) for k, t, *_ in rows for labels, score in [_brute_labels(t, idf)]}
    assert found == expected
    assert all(label in found[k][0].split(",") for k, label in enumerate(licenses.NOTICES))


def test_rarity(make, awkward_rows):
    idf, n = licenses.rarity(make(awkward_rows)), len(awkward_rows)
    for word in ("license", "the", "apache", "mozilla"):
        held = sum(word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for _, t, *_ in awkward_rows)
        assert math.isclose(idf[word], math.log((n + 1) / (held + 1)))


# -- language -----------------------------------------------------------------------------------


def test_language(make, awkward_rows):
    rng = np.random.default_rng(9)
    parts = {"en": "th er on an re the ing".split(), "de": "sch ei ung ich der en".split(), "fr": "eau oi qu ai les ent".split(), "es": "ado cion que os la el".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(40)), lang, "a") for i in range(400) for lang in [list(parts)[i % 4]]]
    found = {r["doc_id"]: r for r in language.identify(make(rows + [(900, None, "en", "a"), (901, "12 34 !!", "en", "a"), (902, "", None, "a")])).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert np.mean([found[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    awkward = language.identify(make(awkward_rows)).collect()
    assert len(awkward) == len(awkward_rows)
    assert {r["lang_pred"] for r in language.identify(make([(1, "abc", None, "a")])).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.identify(make([(k, "abc def", "xx", "a") for k in range(20)])).collect()} == {"xx"}


def test_copies_do_not_thin_the_sample(spark):
    """Every distinct text is an example, however many rows are copies of one text or hold no letter."""
    shown = lambda rows: {r["lang"]: r["count"] for r in language.sampled(rows, per_language=40).groupBy("lang").count().collect()}
    copies = spark.range(20_000).selectExpr("'the same words again' as text", "'en' as lang")
    own = spark.range(30).selectExpr("concat('text number ', chr(int(97 + id % 26)), chr(int(97 + id / 26))) as text", "'en' as lang")
    bare = spark.range(3_000).selectExpr("cast(id as string) as text", "'en' as lang")
    assert shown(copies.union(own).union(bare)) == {"en": 31}
    many = spark.range(5_000).selectExpr("concat('x', translate(cast(id as string), '0123456789', 'abcdefghij')) as text", "'de' as lang")
    assert shown(many.union(copies)) == {"de": 40, "en": 1}


def test_many_languages(make, monkeypatch):
    """More languages than a block holds are all learned; more than a model takes are refused."""
    rng = np.random.default_rng(14)
    names = ["en", "de", "nl", "fr", "es", "ru"] + [f"x{k}" for k in range(14)]
    parts = {s: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(6)] for s in names}
    rows = [(i, " ".join("".join(rng.choice(parts[s], 2)) for _ in range(30)), s, "a") for i in range(600) for s in [names[i % len(names)]]]
    found = {r["doc_id"]: r for r in language.identify(make(rows)).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {found[i]["lang_pred"] for i in held} == set(names)
    assert np.mean([found[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    monkeypatch.setattr(language, "MOST_LANGUAGES", 19)
    with pytest.raises(ValueError):
        language.identify(make(rows))


def test_votes_against_brute_force():
    rng = np.random.default_rng(15)
    for n in (2, 3, 5, 9):
        model = language.OneVersusOne([f"c{k}" for k in range(n)], rng.normal(size=(n * (n - 1) // 2, 8)).astype(np.float32), rng.normal(size=n * (n - 1) // 2))
        for _ in range(40):
            x = rng.normal(size=8).astype(np.float32)
            votes, margins, k = [0] * n, defaultdict(list), 0
            for a in range(n):
                for b in range(a + 1, n):
                    m = sum(float(p) * float(q) for p, q in zip(model.weights[k], x, strict=True)) + model.biases[k]
                    votes[a if m > 0 else b] += 1
                    margins[a].append(m)
                    margins[b].append(-m)
                    k += 1
            best = max(range(n), key=lambda c: (votes[c], 1 + sum(map(math.tanh, margins[c]))))
            name, sure = model.choose(x)
            assert name == f"c{best}" and math.isclose(sure, 1 / (1 + math.exp(-3 * min(margins[best]))), rel_tol=1e-4)


def test_vectors_and_machines():
    x = language.vector("Some words of a text, and some more words")
    counts = Counter()
    b = b" some words of a text and some more words "
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            counts[(int.from_bytes(b[i : i + n], "big") + n) * 2654435761 % 2**32 >> 20] += 1
    norm = math.sqrt(sum(counts.values()))
    assert all(math.isclose(x[k], math.sqrt(c) / norm, rel_tol=1e-5) for k, c in counts.items()) and np.count_nonzero(x) == len(counts)
    assert (language.unpacked(language.packed(x)) == x).all()
    rng = np.random.default_rng(16)
    y = np.repeat([1.0, -1.0], [30, 90])
    points = (rng.normal(size=(120, 6)) + 2 * y[:, None]).astype(np.float32)
    w, bias = language.svm(points, y)
    assert (np.sign((points * w).sum(axis=1) + bias) == y).mean() > 0.98


# -- language model -----------------------------------------------------------------------------


@pytest.mark.parametrize("chars", [20_000_000, 3_000])
def test_lm_base_and_gain(make, awkward_rows, chars):
    rng = np.random.default_rng(10)
    follow = {k: rng.integers(0, 50, 3) for k in range(50)}
    rows = []
    for i in range(300, 520):
        k, text = 0, []
        for _ in range(60):
            k = int(rng.choice(follow[k]))
            text.append(f"w{k}")
        rows.append((i, " ".join(text), "en", "a"))
    rows += [r for r in awkward_rows if r[0] != 103]
    found = lm_score.score(make(rows), bucket_chars=chars).collect()
    tokens = lambda t: [*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = Counter((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == expected
    markov = [r for r in found if r["held_out"] and (r["doc_id"] or 0) >= 300]
    assert sum(r["score"] for r in markov) > 0.75 * sum(r["base_score"] for r in markov) and all(r["score"] < 0 for r in found)


def _customer_by_customer(texts, rounds, burn):
    """Averaged predictions (context, word) -> probability of a two-level Pitman-Yor process, by Gibbs moves of single customers. No code of the operator's."""
    rng = np.random.default_rng(40)
    d, th, d0, th0 = lm_score.DISCOUNT, lm_score.STRENGTH, lm_score.PARENT_DISCOUNT, lm_score.PARENT_STRENGTH
    pairs = [p for t in texts for p in zip(["<s>", *t], [*t, "</s>"], strict=True)]
    words = sorted({w for _, w in pairs})
    contexts = ["<s>", *words, "?"]
    rest, parent = defaultdict(list), defaultdict(list)  # customers by table

    def p0(w):
        n, tables = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(parent[w]) - d0 * len(parent[w]) + (th0 + d0 * tables) / (len(words) + 1)) / (th0 + n)

    def seat(tables, new, discount):
        weights = np.array([n - discount for n in tables] + [new])
        k = int(rng.choice(len(weights), p=weights / weights.sum()))
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def leave(tables):
        k = int(rng.choice(len(tables), p=np.array(tables) / sum(tables)))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def add(u, w):
        own = sum(len(x) for (a, _), x in rest.items() if a == u)
        if seat(rest[u, w], (th + d * own) * p0(w), d):
            seat(parent[w], (th0 + d0 * sum(map(len, parent.values()))) / (len(words) + 1), d0)

    for u, w in pairs:
        add(u, w)
    mean = defaultdict(float)
    for k in range(rounds):
        for u, w in pairs:
            if leave(rest[u, w]):
                leave(parent[w])
            add(u, w)
        if k >= burn:
            for u in contexts:
                n, tables = sum(sum(x) for (a, _), x in rest.items() if a == u), sum(len(x) for (a, _), x in rest.items() if a == u)
                for w in [*words, "?"]:
                    own = rest.get((u, w), [])
                    mean[u, w] += (sum(own) - d * len(own) + (th + d * tables) * p0(w)) / (th + n) / (rounds - burn)
    return mean


@pytest.mark.parametrize("chars", [1_000_000, 60])
def test_lm_scores_against_single_customers(spark, monkeypatch, chars):
    """Over several tasks and buckets, with repeated and null ids: scores near those of customers moved one by one."""
    rng = np.random.default_rng(41)
    texts = [[f"w{min(int(rng.geometric(0.35)), 8)}" for _ in range(int(rng.integers(1, 9)))] for _ in range(24)]
    ids = [None if k % 9 == 8 else k // 2 for k in range(24)]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids]
    assert any(held) and not all(held)
    for name, value in (("SAMPLES", 400), ("BURN_IN", 20)):
        monkeypatch.setattr(lm_score, name, value)
    p = _customer_by_customer([t for t, h in zip(texts, held, strict=True) if not h], 500, 100)
    known = {w for t, h in zip(texts, held, strict=True) if not h for w in t}
    shown = lambda w: w if w in known or w in ("<s>", "</s>") else "?"
    expected = sorted(sum(math.log10(p[shown(u), shown(w)]) for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)) for t in texts)
    rows = spark.sparkContext.parallelize([(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)], 4)
    found = sorted(r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), bucket_chars=chars).collect())
    assert len(found) == 24 and np.allclose(found, expected, rtol=0.06, atol=0.1), list(zip(found, expected, strict=True))


def test_lm_units_with_large_numbers(monkeypatch):
    """Pairs too many to number are sorted by their parts, to the same messages."""
    rng = np.random.default_rng(33)
    vocabulary = lm_score._Vocabulary()
    ids = [np.array([vocabulary[b"%d" % k] for k in rng.integers(0, 40, n)], np.int32) for n in (0, 5, 900, 1, 300)]
    hot = (np.array([lm_score.xxhash.xxh3_64_intdigest(b"7")], np.uint64), np.array([3], np.uint64))
    docs = [(k, k % 3 == 2) for k in range(len(ids))]
    narrow = list(lm_score._unit(ids, docs, vocabulary, 11, hot))
    monkeypatch.setattr(lm_score, "LARGEST_CODE", 0)
    wide = list(lm_score._unit(ids, docs, vocabulary, 11, hot))
    load = lambda rows: [(b, d, {k: (v.dtype, v.tolist()) for k, v in lm_score._load(p).items()}) for b, d, p in rows]
    assert load(narrow) == load(wide) and len(narrow) > 5
    pairs = Counter()
    for x, (_, held) in zip(ids, docs, strict=True):
        said = [lm_score.START, *(lm_score.xxhash.xxh3_64_intdigest(b"%d" % int(list(vocabulary)[k])) for k in x), lm_score.END]
        pairs.update({p: 0 if held else n for p, n in Counter(zip(said, said[1:], strict=False)).items()})
    found = Counter()
    for _, is_docs, payload in narrow:
        if not is_docs:
            p = lm_score._load(payload)
            names = np.cumsum(p["names"], dtype=np.uint64).tolist()
            found.update({(names[u], names[w]): n for u, w, n in zip(np.cumsum(p["u"]).tolist(), p["w"].tolist(), p["trained"].tolist(), strict=True)})
    assert found == pairs and set(found) == set(pairs)


def test_lm_predictions_sum_to_one():
    names = np.array([1, 2, 10, 11, 12], np.uint64)
    payload = lm_score._dump(
        names=np.diff(names, prepend=np.uint64(0)), u=np.diff([0, 2, 2, 2, 3], prepend=0).astype(np.int32), w=np.array([2, 2, 3, 4, 1], np.int32),
        trained=np.array([3, 40, 7, 0, 9], np.int32), entries=np.ones(5, np.int32), doc=np.zeros(5, np.int32), times=np.ones(5, np.int32),
    )
    b, p1 = lm_score._seated([payload], (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    for _ in range(50):
        b.step(p1, b.tables_of_contexts())
        sums = np.add.reduceat(b.sizes, b.since[:-1])
        assert (sums == b.c[b.many]).all() and (b.t[b.many] == [np.count_nonzero(b.sizes[x:y]) for x, y in zip(b.since[:-1], b.since[1:], strict=True)]).all()
        assert (b.t <= b.c).all() and (b.t[b.c > 0] >= 1).all()


def _log_stirlings(c, discount):
    row, t = np.full(c + 1, -np.inf), np.arange(c + 1)
    row[1] = 0
    for n in range(2, c + 1):
        row[1 : n + 1] = np.logaddexp(row[:n], np.log(np.maximum(n - 1 - t[1 : n + 1] * discount, 1e-300)) + row[1 : n + 1])
    return row[1:]


@pytest.mark.parametrize("discount", [0.75, 0.6])
def test_lm_stirling_numbers(discount):
    found, true = lm_score.log_stirling(3000, np.arange(1, 2900), discount), _log_stirlings(3000, discount)[:2899]
    assert np.abs(np.diff(found) - np.diff(true)).max() < 1e-3


def test_lm_steps_reach_the_posterior():
    """Frequent pairs are seated anew: the mean and spread of tables are those of the exact posterior."""
    counts, p1 = (3000, 400), np.array([0.2, 0.4, 0.2, 0.2])
    names = np.array([1, 2, 10, 11], np.uint64)
    payload = lm_score._dump(
        names=np.diff(names, prepend=np.uint64(0)), u=np.diff([0, 0], prepend=0).astype(np.int32), w=np.array([1, 2], np.int32),
        trained=np.array(counts, np.int32), entries=np.ones(2, np.int32), doc=np.zeros(2, np.int32), times=np.ones(2, np.int32),
    )
    b, _ = lm_score._seated([payload], (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    seen = []
    for _ in range(3000):
        b.step(p1, b.tables_of_contexts())
        seen.append(b.t.copy())
    logs = [_log_stirlings(c, lm_score.DISCOUNT)[:400] + np.arange(1, 401) * np.log(p) for c, p in zip(counts, p1[1:3], strict=True)]
    rising = np.concatenate(([0], np.cumsum(np.log(lm_score.STRENGTH + lm_score.DISCOUNT * np.arange(801)))))
    both = logs[0][:, None] + logs[1][None, :] + rising[np.add.outer(np.arange(1, 401), np.arange(1, 401))]
    both = np.exp(both - both.max()) / np.exp(both - both.max()).sum()
    for axis in (0, 1):
        own, at = both.sum(axis=1 - axis), np.arange(1, 401)
        mean = (own * at).sum()
        spread = math.sqrt((own * (at - mean) ** 2).sum())
        draws = np.array(seen[50:])[:, axis]
        assert abs(draws.mean() - mean) < 0.4 * spread and 0.7 * spread < draws.std() < 1.4 * spread


def test_lm_units_of_other_words_under_the_same_ids(spark):
    """Tasks whose documents share ids and lengths but not words are scored apart."""
    texts = ["a b", "c d", "a a a b b"]
    parts = spark.sparkContext.parallelize([(None, "a b"), (None, "c d"), (4, texts[2])], 3)
    found = lm_score.score(spark.createDataFrame(parts, "doc_id long, text string")).collect()
    held = zlib.crc32(b"4") % 7 == 2
    count = Counter(w for t in texts[: 2 if held else 3] for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    expected = sorted(round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*t.split(), None]), 4) for t in texts)
    assert not held and len(set(expected)) == 3 and sorted(round(r["base_score"], 4) for r in found) == expected


# -- none at all --------------------------------------------------------------------------------


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exact_dedup.exact_groups(nothing),
        exact_dedup.exact_dedup(nothing),
        near_dedup.near_classes(nothing),
        near_dedup.near_dedup(nothing),
        quality.quality_rules(nothing, labels),
        quality.quality_filter(nothing, labels),
        mixing.mix(nothing),
        mixing.mix_documents(nothing),
        packing.pack(nothing),
        sharding.place(nothing, "doc_id", ["a"], 7),
        licenses.scan(nothing),
        language.identify(nothing),
        lm_score.score(nothing),
        chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.count() == 0


def test_base_scores_alone_equal_those_of_the_model(spark):
    rows = [(k, " ".join(f"W{(k * j) % 13}" for j in range(k % 9))) for k in range(60)] + [(3, None), (None, "w1 \x0bw2 new"), (7, "a b"), (7, "a b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    seen = lambda df: Counter((*(r[c] for c in columns), round(r["base_score"], 6)) for r in df.collect())
    for folds, held in ((7, 2), (1, 0), (1, 1)):  # some, all and none held out
        assert seen(lm_score.base_scores(docs, folds, held, 50)) == seen(lm_score.score(docs, folds, held, 50))
    assert lm_score.base_scores(docs.limit(0)).count() == 0


def test_base_scores_seat_nobody(spark, tmp_path):
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lm_score.lm_base_scores(spark, str(tmp_path))
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first()["n_tokens"] == 4
