"""Quality rules: decision lists learned by sequential covering. DataFrame functions only.

Statistics of each text are computed by column expressions. The labelled documents' statistics are
cut at their quantiles; sequential covering then grows one conjunction of thresholds after the
other. Each step is one aggregation of all labelled rows that are still uncovered, giving the good
and bad counts by statistic and bin (a table of fixed size), from which the condition with the
highest FOIL gain is taken. A rule is pruned to its best prefix on held-back rows and is accepted
only if it is precise there. The list is emitted as one ordered ``when ... when ... otherwise``.

Defined cases: null text has no words, all its counts are 0, and it fails the base rule; a null
quality label is not used; documents without labels, or no labels at all, leave the base rule
alone; repeated rows get equal verdicts, row by row; an empty table gives an empty result. Other
columns are ignored by ``quality_rules`` and kept by ``quality_filter``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrow.llm.common import SQL_WORDS, WORD, checkpoint, let, table, text_or_empty, words

WINDOW = 8
#: Characters that count as symbols and as ends of sentences or clauses.
SYMBOLS, STOPS = "#*$%&|<>", ".,;:!?"
BINS = 24
MOST_CONDITIONS = 4
MOST_RULES = 12
#: A rule must be this precise on the rows held back for pruning, and cover this many bad ones there.
PRECISION = 0.97
SUPPORT = 5


def _repeated(w: Column, h: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more; h: the words' hashes."""
    n = F.size(w)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(WINDOW))))
    # Only texts with a repeated hash are looked at by the windows themselves.
    sorted_windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("key"), i.alias("at"))))

    def covered(a: Column) -> Column:
        key = lambda i: F.get(a, i)["key"]
        places = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.when((key(i) == key(i + 1)) | (key(i) == key(i - 1)), F.get(a, i)["at"]))
        steps = lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1),
            F.lit(0).cast("long"),
            lambda total, i: total + F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW))),
        )
        return let(F.array_sort(F.array_compact(places)), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(steps(p)))

    repeats = let(hashes, lambda x: F.size(x) > F.size(F.array_distinct(x)))
    return F.when((n > WINDOW) & repeats, let(sorted_windows, covered)).otherwise(F.lit(0).cast("long"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


#: Statistics that rules may test, each made of the counts that the function given to it gets by name.
_ratio = lambda over, under: lambda get: get(over) / F.greatest(get(under), F.lit(1))
FEATURES = {
    "n_words": lambda get: get("n_words").cast("double"),
    "mean_word": _ratio("word_chars", "n_words"),
    "symbols": _ratio("n_symbols", "n_words"),
    "dup_lines": _ratio("n_dup_lines", "n_lines"),
    "repeats": _ratio("n_repeat_words", "n_words"),
    "distinct": _ratio("n_distinct", "n_words"),
    "stops": _ratio("n_stops", "n_words"),
    "capitals": _ratio("n_capitals", "n_words"),
    "digits": _ratio("n_digits", "n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_stops", "n_capitals", "n_digits")


def _counts(text: Column) -> Column:
    long = lambda c: c.cast("long")
    counted = lambda w, h: F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        _repeated(w, h).alias("n_repeat_words"),
        long(F.size(F.array_distinct(h))).alias("n_distinct"),
    )
    of_words = let(words(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: counted(w, h)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(
            *(s["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct")),
            *(s["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")),
            *(_count(text, f"[{x}]").alias(c) for c, x in (("n_symbols", SYMBOLS), ("n_stops", STOPS), ("n_capitals", "A-Z"), ("n_digits", "0-9"))),
        ),
    )


@dataclass
class Rule:
    """A conjunction of (statistic, at_most, threshold): value <= threshold, or value > threshold."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self, get=F.col) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.conditions:
            value = FEATURES[name](get)
            out = out & (value <= threshold if at_most else value > threshold)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if m else '>'} {t:g}" for n, m, t in self.conditions)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(statistics: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for bad documents, in order, from the statistics of those with a quality label."""
    known = statistics.join(labels.filter("quality is not null").select("doc_id", (F.col("quality") == 0).cast("long").alias("bad")), "doc_id")
    rows = known.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *(e(F.col).alias(c) for c, e in FEATURES.items()))
    cuts = rows.select(*(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 2000).alias(c) for c in FEATURES)).first()
    cuts = {c: sorted(set(cuts[c] or ())) for c in FEATURES}
    if not any(cuts.values()):
        return []
    binned = lambda c: sum(((F.col(c) > t).cast("int") for t in cuts[c]), F.lit(0)).alias(c)
    rows = checkpoint(rows.select("bad", "held", *map(binned, FEATURES)))

    def holds(conditions: list[tuple[str, bool, int]]) -> Column:
        """Conditions are on bins here: bin <= b is value <= cuts[b]."""
        out = F.lit(True)
        for c, at_most, b in conditions:
            out = out & (F.col(c) <= b if at_most else F.col(c) > b)
        return out

    left, rules = rows, []
    while len(rules) < MOST_RULES:
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < MOST_CONDITIONS:
            inside = left.filter(~F.col("held")).filter(holds(grown))
            stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("bin")) for c in FEATURES))).alias("f")
            counts = inside.select("bad", stacked).groupBy("f.name", "f.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("all")).collect()
            best, choice = 1e-9, None
            for c in FEATURES:
                by = {r["bin"]: (r["p"], r["all"] - r["p"]) for r in counts if r["name"] == c}
                p0, n0 = (sum(x[k] for x in by.values()) for k in (0, 1))
                if not p0 or not n0:
                    break
                p = n = 0
                for b in range(len(cuts[c])):
                    p, n = p + by.get(b, (0, 0))[0], n + by.get(b, (0, 0))[1]
                    for at_most, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        if (gain := _gain(pp, nn, p0, n0)) > best * (1 + 1e-12):
                            best, choice = gain, (c, at_most, b)
            if choice is None:
                break
            grown.append(choice)
        if not grown:
            break
        prefixes = [grown[: k + 1] for k in range(len(grown))]
        held = left.filter("held").select(*(F.sum(F.when(holds(x), v)).alias(f"{k}{s}") for k, x in enumerate(prefixes) for s, v in (("p", F.col("bad")), ("n", 1 - F.col("bad"))))).first()
        worth = [((held[f"{k}p"] or 0), (held[f"{k}n"] or 0)) for k in range(len(prefixes))]
        at = max(range(len(prefixes)), key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), worth[k][0], -k))
        p, n = worth[at]
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(Rule([(c, m, float(cuts[c][b])) for c, m, b in prefixes[at]]))
        left = left.filter(~holds(prefixes[at]))
    return rules


def verdict(rules: list[Rule], get=F.col) -> Column:
    """The list as one ordered conditional: the number of the first rule that fires (from 1), else 0."""
    out = F.when(F.lit(False), 0)
    for k, rule in enumerate(rules):
        out = out.when(rule.column(get), k + 1)
    return out.otherwise(0)


def base_failed(get=F.col) -> Column:
    return (get("n_words") < 20) | (100 * get("n_repeat_words") > 30 * get("n_words"))


def _judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return rows.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _counts(text_or_empty()).alias("c")).select("doc_id", *(F.col(f"c.{c}").alias(c) for c in COUNTS))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, and the number of the rule that fired."""
    rows = checkpoint(statistics(docs))
    return _judged(rows, learn(rows, labels))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. The counts are computed again instead of moving texts through a join."""
    rules = learn(checkpoint(statistics(docs)), labels)
    # One expression: as columns of their own, the counts would be computed again for each condition that is pushed below them.
    return docs.filter(let(_counts(text_or_empty()), lambda c: ~base_failed(c.getItem) & (verdict(rules, c.getItem) == 0)))


def op4_quality_rules(spark, sf_dir):
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, "rule")


def quality_counts(spark, sf_dir):
    """What of op4 SQL can express: the counts and the base rule, without the learned verdict."""
    return op4_quality_rules(spark, sf_dir).drop("kept", "rule")


QUERIES = {"op4_quality_rules": op4_quality_rules, "quality_counts": quality_counts}
ORACLE_SQL = {
    "quality_counts": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, {SQL_WORDS.format("t")} AS ws FROM d),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS times
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM windows WHERE times > 1) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
       coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(repeats.n, 0) > 30 * len(ws) AS base_failed
FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)"""
}
