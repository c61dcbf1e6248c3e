"""Licence scan with a positional index over the rarest words of licence texts."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.common import text_of

#: Everything that is neither an ASCII letter or digit nor beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a licence by themselves.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Template:
    """A licence notice; ``key`` is the phrase of it that must stand in the text word for word."""

    label: str
    text: str
    key: str


# The notices that are looked for.
TEMPLATES = (
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge to any person"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
)


@dataclass(frozen=True)
class LicenseSpec:
    templates: tuple[Template, ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    #: How many of its rarest words stand for a template in the index.
    rare_words: int = 4


def license_words(text: Column) -> Column:
    """Words with A-Z in lower case.

    ``lower`` also changes letters beyond ASCII, which no phrase has; only the Kelvin sign would turn
    into an ASCII letter, so it is replaced by another letter first.
    """
    plain = F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each of the vocabulary's words: one number per word comes back."""
    found = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    rows = words.select(F.explode(F.array_append(found, F.lit(""))).alias("word"))
    counts = {r.word: r.n for r in rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def scan_licenses(
    docs: DataFrame, spec: LicenseSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document with the licence phrases and notices in its text.

    Returns ``doc_id, n_words``; ``n_base, first_word, last_word, base_labels`` for the phrases;
    ``matches`` (label, first word and score of each notice), ``labels`` of both and ``score``. A
    notice's score is the share of its words' information that stands where the notice has it; a
    phrase alone scores a half. Null and empty texts have no words and no labels; empty tables give
    no rows; repeated rows are scanned like others, and no other column is read.

    The corpus says how rare the words of the notices are. Each notice is indexed under its rarest
    words with their positions. A text looks its words up there, which gives the places where a
    notice could start; the key phrase is then compared word for word. After one small count the
    whole scan is row by row, without a shuffle.
    """
    spec = spec or LicenseSpec()
    words = docs.select(F.col(id_col).alias("doc_id"), license_words(text_of(text_col)).alias("words"))
    notices = [t.text.split() for t in spec.templates]
    vocabulary = sorted({w for notice in notices for w in notice})
    total, seen = document_frequencies(words, vocabulary)
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    rare = [
        sorted(set(notice), key=lambda w: (-idf[w], w))[: spec.rare_words] for notice in notices
    ]
    index: dict[str, list[tuple[int, int]]] = {}
    for t, notice in enumerate(notices):
        for at, word in enumerate(notice):
            if word in rare[t]:
                index.setdefault(word, []).append((t, at))
    known = sorted(index)
    postings = F.create_map(*[
        x for word in known for x in (
            F.lit(word), F.array(*[F.struct(F.lit(t).alias("notice"), F.lit(at).alias("at")) for t, at in index[word]])
        )
    ])
    patterns = F.array(*[_pattern(t, notice, idf) for t, notice in zip(spec.templates, notices)])

    word_at = lambda i: F.get("words", i)
    places = F.sequence(F.lit(0), F.size("words") - 1)
    looked_up = F.filter(places, lambda i: word_at(i).isin(known))
    starts = F.array_distinct(F.flatten(F.transform(
        looked_up,
        lambda i: F.transform(
            F.element_at(postings, word_at(i)),
            lambda p: F.struct(p["notice"].alias("notice"), (i - p["at"]).alias("start")),
        ),
    )))
    holds = F.filter("starts", lambda s: F.forall(
        F.get("patterns", s["notice"])["key"], lambda k: word_at(s["start"] + k["at"]) == k["word"]
    ))
    score_of = lambda s: F.aggregate(
        F.get("patterns", s["notice"])["words"], F.lit(0.0),
        lambda acc, x: acc + F.when(word_at(s["start"] + x["at"]) == x["word"], x["share"]).otherwise(0.0),
    )
    matches = F.transform(holds, lambda s: F.struct(
        F.get("patterns", s["notice"])["label"].alias("label"), s["start"].alias("start"),
        F.least(F.lit(1.0), score_of(s)).alias("score"),
    ))
    none = F.array().cast("array<struct<notice:int,start:int>>")
    found = words.withColumn(
        "starts", F.when(F.exists("words", lambda w: w.isin(known)), starts).otherwise(none)
    ).withColumn("patterns", patterns)
    phrase_words = [p.split() for p, _ in spec.phrases]
    firsts = sorted({p[-1] for p in phrase_words})

    def places_of(phrase: list[str], label: str) -> Column:
        return F.transform(
            F.filter(places, lambda i: _stands(word_at, i, phrase)),
            lambda i: F.struct(i.alias("at"), (i + len(phrase) - 1).alias("end"), F.lit(label).alias("label")),
        )

    at_phrase = F.array(*[places_of(p, label) for p, (_, label) in zip(phrase_words, spec.phrases)])
    none = F.array().cast("array<struct<at:int,end:int,label:string>>")
    found = found.withColumn(
        "phrases", F.when(F.exists("words", lambda w: w.isin(firsts)), F.flatten(at_phrase)).otherwise(none)
    )
    found = found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "phrases", matches.alias("matches")
    )
    base = F.array_distinct(F.transform("phrases", lambda p: p["label"]))
    best = F.array_max(F.transform("matches", lambda m: m["score"]))
    half = F.when(F.size("phrases") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(
            F.sort_array(F.array_union(base, F.transform("matches", lambda m: m["label"]))), ","
        ).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), half).alias("score"), "matches",
    )


def _stands(word_at, i, phrase: list[str]) -> Column:
    cond = word_at(i) == phrase[0]
    for k, word in enumerate(phrase[1:], 1):
        cond = cond & (word_at(i + k) == word)
    return cond


def _pattern(template: Template, notice: list[str], idf: dict[str, float]) -> Column:
    key = template.key.split()
    start = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
    total = sum(idf[w] for w in notice)
    return F.struct(
        F.lit(template.label).alias("label"),
        F.array(*[
            F.struct(F.lit(start + i).alias("at"), F.lit(w).alias("word")) for i, w in enumerate(key)
        ]).alias("key"),
        F.array(*[
            F.struct(F.lit(i).alias("at"), F.lit(w).alias("word"), F.lit(idf[w] / total).alias("share"))
            for i, w in enumerate(notice)
        ]).alias("words"),
    )


def find_labels_plainly(text: str, spec: LicenseSpec | None = None) -> tuple[int, list[tuple[int, str]], set[str]]:
    """The same scan of one text by comparing at every word: words, phrase places, labels. For tests."""
    spec = spec or LicenseSpec()
    lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split(SEPARATORS, lowered) if w]

    def places(phrase: str) -> list[int]:
        p = phrase.split()
        return [i for i in range(len(words)) if words[i : i + len(p)] == p]

    base = sorted((i, label) for phrase, label in spec.phrases for i in places(phrase))
    labels = {label for _, label in base} | {t.label for t in spec.templates if places(t.key)}
    return len(words), base, labels
