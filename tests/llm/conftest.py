import random

import pytest

#: Names that operators could use themselves.
EXTRA = ["size", "kept", "class", "shard", "slot", "key", "node", "rank", "label", "target", "hash", "rows", "value", "text_hash", "held_out"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in EXTRA)


def sentence(rng, n, words=("the of and to in that is was for with as on be at by his her they from this under mit license cc by nc apache version 2").split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "x", "ing", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def build(rows):
        """rows: (doc_id, text, lang, source)."""
        full = [(i, t, lang, source, None if t is None else len(t), *(f"{n}!" for n in EXTRA)) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(5)
    plain = [(i, sentence(rng, rng.randint(1, 120)) + ".", rng.choice(["en", "de", "fr"]), rng.choice(["a", "b", "c"])) for i in range(60)]
    long = sentence(rng, 30_000)
    return plain + [
        (100, None, "en", "a"),
        (101, "", None, None),
        (102, " \n\t ", "en", "a"),
        (None, "words without an id of their own", "en", "b"),
        (None, None, None, None),
        (103, long, "en", None),
        (104, plain[3][1], "en", "a"),
        (105, plain[3][1].replace(" ", "\n"), "en", "a"),
        (7, plain[7][1], *plain[7][2:]),
        (7, "another text under an id that is taken", "en", "a"),
        (106, "İ K é ﬁ 漢字 \x1c \x85 🙂 </s>[INST] <|endoftext|>", "fr", "ß"),
        (107, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "a"),
        (-5, "negative id", "en", "a"),
    ]


@pytest.fixture(scope="session")
def awkward(make, awkward_rows):
    return make(awkward_rows).cache()


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
