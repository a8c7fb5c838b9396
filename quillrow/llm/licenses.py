r"""License scan by a positional rare-token index. DataFrame functions only.

Licence phrases and notices are templates: word lists with positions. Document frequencies of all
template words, over all documents, give their IDF; the rarest words of each template go into an
index, a table of word to (template, position). For a file, all indexed words it holds are looked
up; their postings turn each place in the file into an offset at which a template would have to
begin, and the offset that most postings share, a few words more or less, is the template's
alignment. A notice is found if enough of its rare words align and its mandatory key phrases stand
in the file; a phrase is found at every place where its rarest word's posting aligns and all its
other words stand at their relative positions. Index and templates are constants of the plan, so
its size does not depend on their number.

Defined cases: null text is empty; a file without licence words has no label, score 0 and null
word positions; words are lower-cased; repeated rows are scanned each; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrow.llm.common import SQL_LOWER, let, table, text_or_empty

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a licence, and the label each gives.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Excerpts of public licence notices, and the phrases that each must contain.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may"
        " obtain a copy of the license at http www apache org licenses license 2 0",
        ("apache license", "in compliance with the license"),
    ),
    "bsd-3": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
        " are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain"),
    ),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file",
        ("mozilla public license",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the"
        " above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or"
        " distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    "bsd-4": (
        "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by",
        ("all advertising materials mentioning features or use of this software",),
    ),
    "gpl-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
        " software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "version 2 of the license"),
    ),
    "gpl-3-or-later": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either"
        " version 3 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    "lgpl-2.1": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by"
        " the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license", "version 2 1 of the license"),
    ),
    "lgpl-3": (
        "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your"
        " option any later version",
        ("gnu lesser general public license", "version 3 of the license"),
    ),
    "agpl-3": (
        "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your"
        " option any later version",
        ("gnu affero general public license",),
    ),
    "gfdl-1.3": (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any"
        " later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts",
        ("gnu free documentation license",),
    ),
    "epl-1": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
        ("eclipse public license v1 0",),
    ),
    "epl-2": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www"
        " eclipse org legal epl 2 0",
        ("eclipse public license 2 0",),
    ),
    "cddl-1": (
        "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except"
        " in compliance with the license",
        ("common development and distribution license",),
    ),
    "mpl-1.1": (
        "the contents of this file are subject to the mozilla public license version 1 1 the license software distributed under the license is distributed"
        " on an as is basis without warranty of any kind either express or implied",
        ("mozilla public license version 1 1",),
    ),
    "bsl-1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered"
        " by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works",
        ("any person or organization obtaining a copy", "covered by this license"),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from"
        " the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it"
        " and redistribute it freely",
        ("including commercial applications and to alter it and redistribute it freely",),
    ),
    "wtfpl": (
        "do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to",
        ("do what the fuck you want to",),
    ),
    "artistic-2": (
        "the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this"
        " license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
        ("artistic license", "given free software package may be copied"),
    ),
    "postgresql": (
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is"
        " hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
        ("without a written agreement", "this paragraph and the following two paragraphs"),
    ),
    "ms-pl": (
        "microsoft public license this license governs use of the accompanying software if you use the software you accept this license if you do not accept"
        " the license do not use the software",
        ("microsoft public license", "governs use of the accompanying software"),
    ),
    "ms-rl": (
        "microsoft reciprocal license this license governs use of the accompanying software if you use the software you accept this license if you do not"
        " accept the license do not use the software",
        ("microsoft reciprocal license", "governs use of the accompanying software"),
    ),
    "eupl-1.2": (
        "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence you may"
        " not use this work except in compliance with the licence",
        ("european commission", "subsequent versions of the eupl"),
    ),
    "ofl-1.1": (
        "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at",
        ("sil open font license",),
    ),
    "ncsa": (
        "to deal with the software without restriction redistributions in binary form must reproduce the above copyright notice this list of conditions and"
        " the following disclaimers in the documentation neither the names of nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission",
        ("to deal with the software without restriction", "the following disclaimers"),
    ),
    "psf-2": (
        "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this"
        " software python in source or binary form and its associated documentation",
        ("python software foundation", "otherwise using"),
    ),
    "0bsd": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"
        " and the author disclaims all warranties with regard to this software",
        ("with or without fee is hereby granted the software is provided as is",),
    ),
    "cc0-1": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    "cc-by-4": (
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org"
        " licenses by 4 0",
        ("creative commons attribution 4 0 international",),
    ),
    "cc-by-sa-4": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit http"
        " creativecommons org licenses by sa 4 0",
        ("creative commons attribution sharealike 4 0 international",),
    ),
    "cc-by-nc-4": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http"
        " creativecommons org licenses by nc 4 0",
        ("creative commons attribution noncommercial 4 0 international",),
    ),
    "cc-by-nd-4": (
        "this work is licensed under a creative commons attribution noderivatives 4 0 international license to view a copy of this license visit http"
        " creativecommons org licenses by nd 4 0",
        ("creative commons attribution noderivatives 4 0 international",),
    ),
    "beerware": (
        "the beer ware license wrote this file as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you"
        " think this stuff is worth it you can buy me a beer in return",
        ("as long as you retain this notice you can do whatever you want with this stuff",),
    ),
    "vim": (
        "there are no restrictions on distributing unmodified copies of vim except that they must include this license text",
        ("distributing unmodified copies of vim",),
    ),
    "openssl": (
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        ("for use in the openssl toolkit",),
    ),
    "json": ("the software shall be used for good not evil", ("shall be used for good not evil",)),
    "osl-3": ("licensed under the open software license version 3 0", ("open software license version 3 0",)),
    "afl-3": ("licensed under the academic free license version 3 0", ("academic free license version 3 0",)),
}
#: A notice's rarest words that are indexed, the share of postings that must align, and the words by which their beginnings may differ.
RARE, ALIGNED, SLACK = 8, 0.6, 4


def file_words(text: Column) -> Column:
    """A file's words. Templates are ASCII, so of all other letters only the Kelvin sign, whose lower case is an ASCII k, must be kept from lower()."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u1d0b"))), GAPS), "")


def template_words() -> list[str]:
    return sorted({w for t in [*PHRASES, *(n for n, _ in NOTICES.values())] for w in t.split()})


def rarity(docs: DataFrame) -> dict[str, float]:
    """IDF of each template word over all documents. One row for each template word reaches the driver."""
    vocabulary = template_words()
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(F.array(*map(F.lit, vocabulary)), file_words(text_or_empty())))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # the empty word stands once in each document
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


@dataclass(frozen=True)
class Index:
    """The templates' postings, as data: columns that hold one constant each, whatever the number of templates."""

    #: All words that stand in the two maps.
    words: Column
    #: word -> (template, its place there, number of the posting in the template) for the rare words of each notice.
    postings: Column
    #: By notice: label, number of postings, mandatory phrases.
    notices: Column
    #: word -> numbers of the phrases whose rarest word it is.
    anchors: Column
    #: By phrase: label, words, place of the rarest.
    phrases: Column


def index(idf: dict[str, float]) -> Index:
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    rarest = lambda found: sorted(set(found), key=lambda x: (-idf[x], x))
    postings, notices, anchors, phrases = {}, [], {}, []
    for template, (label, (notice, keys)) in enumerate(NOTICES.items()):
        said = notice.split()
        rare = set(rarest(said)[:RARE])
        places = [p for p, word in enumerate(said) if word in rare]
        for number, p in enumerate(places):
            postings.setdefault(said[p], []).append({"template": template, "place": p, "number": number})
        notices.append({"label": label, "postings": len(places), "keys": [f" {k} " for k in keys]})
    for k, (phrase, label) in enumerate(PHRASES.items()):
        said = phrase.split()
        anchors.setdefault(rarest(said)[0], []).append(k)
        phrases.append({"label": label, "words": said, "anchor": said.index(rarest(said)[0])})
    return Index(
        constant(sorted({*postings, *anchors}), "array<string>"),
        constant(postings, "map<string,array<struct<template:int,place:int,number:int>>>"),
        constant(notices, "array<struct<label:string,postings:int,keys:array<string>>>"),
        constant(anchors, "map<string,array<int>>"),
        constant(phrases, "array<struct<label:string,words:array<string>,anchor:int>>"),
    )


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _phrases_at(ix: Index, w: Column, i: Column) -> Column:
    """(start, label) of the phrases whose rarest word stands at place i and the others beside it."""

    def found(k: Column) -> Column:
        phrase = F.get(ix.phrases, k)
        start = i - phrase["anchor"]
        stands = F.when(start >= 0, F.slice(w, start + 1, F.size(phrase["words"])) == phrase["words"])
        return F.when(stands, F.struct(start.alias("start"), phrase["label"].alias("label")))

    return F.array_compact(F.transform(F.coalesce(F.try_element_at(ix.anchors, F.get(w, i)), _empty("int")), found))


def _alignments(ix: Index, w: Column, at: Column) -> Column:
    """(template, most): for each notice with a posting at one of the places, the most postings, each counted once, that agree within SLACK words on its beginning."""
    posting = "struct<template:int,begin:int,number:int>"
    begun = lambda i: F.transform(
        F.coalesce(F.try_element_at(ix.postings, F.get(w, i)), _empty("struct<template:int,place:int,number:int>")),
        lambda p: F.struct(p["template"].alias("template"), (i - p["place"]).alias("begin"), p["number"].alias("number")),
    )
    start = F.struct(F.lit(-1).alias("template"), _empty(posting).alias("near"), F.lit(0).alias("most"), _empty("struct<template:int,most:int>").alias("found"))
    closed = lambda s: F.array_append(s["found"], F.struct(s["template"].alias("template"), s["most"].alias("most")))

    def count(s: Column, x: Column) -> Column:  # postings come by template and beginning
        same = s["template"] == x["template"]
        near = F.array_append(F.filter(s["near"], lambda y: (y["template"] == x["template"]) & (y["begin"] >= x["begin"] - SLACK)), x)
        agree = lambda n: F.size(F.array_distinct(F.transform(n, lambda y: y["number"])))
        return let(
            near,
            lambda n: F.struct(
                x["template"].alias("template"),
                n.alias("near"),
                F.greatest(F.when(same, s["most"]).otherwise(0), agree(n)).alias("most"),
                F.when(same, s["found"]).otherwise(closed(s)).alias("found"),
            ),
        )

    return F.aggregate(F.sort_array(F.flatten(F.transform(at, begun))), start, count, lambda s: F.filter(closed(s), lambda f: f["template"] >= 0))


def _judged(ix: Index, w: Column, at: Column) -> Column:
    """(starts, base, shares) of a file's words, given the places of the indexed ones."""

    def share(f: Column, sure: Column) -> Column:
        notice = F.get(ix.notices, f["template"])
        value = f["most"] / notice["postings"]
        return F.struct(notice["label"].alias("label"), value.alias("share"), ((value >= ALIGNED) & sure).alias("sure"))

    def shares(found: Column) -> Column:
        enough = F.exists(found, lambda f: f["most"] / F.get(ix.notices, f["template"])["postings"] >= ALIGNED)
        said = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))  # only where a notice may stand
        verified = let(said, lambda t: F.transform(found, lambda f: share(f, F.forall(F.get(ix.notices, f["template"])["keys"], lambda k: t.contains(k)))))
        return F.when(enough, verified).otherwise(F.transform(found, lambda f: share(f, F.lit(False))))

    phrases = F.flatten(F.transform(at, lambda i: _phrases_at(ix, w, i)))
    return let(
        phrases,
        lambda p: F.struct(
            F.sort_array(F.transform(p, lambda x: x["start"])).alias("starts"),
            F.transform(p, lambda x: x["label"]).alias("base"),
            let(_alignments(ix, w, at), shares).alias("shares"),
        ),
    )


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, phrase_starts."""
    ix = index(rarity(docs) if idf is None else idf)
    nothing = F.struct(_empty("int").alias("starts"), _empty("string").alias("base"), _empty("struct<label:string,share:double,sure:boolean>").alias("shares"))

    def labels_of(w: Column) -> Column:
        own = F.array_intersect(ix.words, w)
        at = let(own, lambda x: F.when(F.size(x) == 0, _empty("int")).otherwise(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(x, F.get(w, i)))))
        judged = let(at, lambda i: F.when(F.size(i) > 0, _judged(ix, w, i)).otherwise(nothing))
        return F.struct(F.size(w).cast("long").alias("n_words"), judged.alias("found"))

    rows = docs.select("doc_id", let(file_words(text_or_empty()), labels_of).alias("s")).select("doc_id", "s.n_words", "s.found.*")
    sure = F.transform(F.filter("shares", lambda x: x["sure"]), lambda x: x["label"])
    best = F.array_max(F.transform("shares", lambda x: F.when(x["sure"], x["share"]).otherwise(x["share"] / 2)))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.get("starts", F.lit(0)).cast("long").alias("first_word"),
        F.get("starts", F.size("starts") - 1).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", sure)).alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.col("starts").alias("phrase_starts"),
    )


def op8_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("phrase_starts")


def license_places(spark, sf_dir):
    """What of op8 SQL can express: the places and labels of the base phrases."""
    return op8_license_scan(spark, sf_dir).drop("labels", "score")


QUERIES = {"op8_license_scan": op8_license_scan, "license_places": license_places}
ORACLE_SQL = {
    "license_places": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p AS (SELECT * FROM (VALUES {", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in PHRASES.items())}) v(phrase, label, n)),
found AS (
  SELECT r, i, label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), p
  WHERE ws[i] = split_part(phrase, ' ', 1) AND array_to_string(ws[i:i + n - 1], ' ') = phrase)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN (
  SELECT r, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM found GROUP BY r) USING (r)"""
}
