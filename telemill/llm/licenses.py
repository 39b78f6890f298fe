"""License scans: phrases at their places, and notices found by an index of their rare words by position.

Base labels are those of phrases whose words stand consecutively in a text. The method adds others from templates, each a
label, the words of a notice, and mandatory key phrases of it:

1. The templates' words are counted in all documents; the fewer documents have a word, the higher its IDF.
2. A file that has all words of a template's key phrases is a candidate for it. Of the template's words that the file has,
   the LOOKED_UP of highest IDF are looked up: their places in the file against their places in the template (the index's
   postings) give relative positions, and so do the places of the key phrases.
3. Relative positions are met in bands of 2 * SLACK, on two grids shifted by SLACK, so that words at most SLACK apart from
   their places always share a band. Where a band has all key phrases and SHARE of the words looked up, the label holds.

Labels depend on a text alone, and rows of a text and band are combined by the union of what they found, so that repeated
rows change nothing. Null texts are empty. Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import bound
from telemill.plans.lineage import drop_written, sized_join, written

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOOKED_UP, SLACK, SHARE = 8, 8, 0.75

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Opening words of public licences, and the notices by which works name them, with what each must say.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "released under the terms of the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license see the license file in the project root for details", ("under the mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("lgpl-3", "this library is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "this program is licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", ("dedicated the work to the public domain",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, _BETWEEN), lambda w: w != "")


def places(all_words: Column, joined: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively, by word from 0; joined: the words with a space before and behind each.
    Texts without the phrase aren't walked through."""
    want = phrase.split()

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(want):
            out = out & F.coalesce(F.get(all_words, i + k) == w, F.lit(False))
        return out

    starts = F.filter(F.transform(all_words, lambda w, i: F.when((w == want[0]) & here(i), i)), lambda i: i.isNotNull())
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), starts).otherwise(F.array().cast("array<int>"))


def _spaced(all_words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(all_words, " "), F.lit(" "))


def based(docs: DataFrame, phrases: dict[str, str], vocabulary: list[str]) -> DataFrame:
    """doc_id, __key (the text's 256-bit digest), n_words, n_base, first_word, last_word, __base (labels), __held (the words
    of the vocabulary that the text has)."""
    names = list(phrases)

    def one(w: Column, joined: Column) -> Column:
        at = [places(w, joined, p) for p in names]
        known = F.array_intersect(w, F.array(*[F.lit(x) for x in vocabulary]))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.array(*at).alias("at"), known.alias("held"))

    all_words = words(F.col("text"))
    found = bound(all_words, lambda w: bound(_spaced(w), lambda j: one(w, j)))
    d = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("__key"), found.alias("f"))
    flat = F.flatten("f.at")
    labels = F.array_distinct(F.filter(F.array(*[F.when(F.size(F.col("f.at")[i]) > 0, F.lit(phrases[p])) for i, p in enumerate(names)]), lambda x: x.isNotNull()))
    return d.select("doc_id", "__key", "f.n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"), labels.alias("__base"), F.col("f.held").alias("__held"))


def postings(spark, templates: tuple[Template, ...]) -> DataFrame:
    """template, word, at: the places of words in templates; as many rows as these have words."""
    rows = [(i, w, k) for i, t in enumerate(templates) for k, w in enumerate(t.text.split())]
    return spark.createDataFrame(rows, "template int, word string, at int")


def candidates(about: DataFrame, templates: tuple[Template, ...], rare: list[str], looked_up: int = LOOKED_UP) -> DataFrame:
    """__key, template, look (words to look up, of highest IDF first) of texts that have all words of a template's keys.
    rare: the templates' words, those of highest IDF first."""
    rank = {w: i for i, w in enumerate(rare)}
    out = []
    for i, t in enumerate(templates):
        must = sorted({w for k in t.keys for w in k.split()})
        own = sorted(set(t.text.split()), key=rank.get)
        has = F.size(F.array_except(F.array(*[F.lit(w) for w in must]), "__held")) == 0
        look = F.slice(F.filter(F.array(*[F.lit(w) for w in own]), lambda w: F.array_contains("__held", w)), 1, looked_up)
        out.append(F.when(has, F.struct(F.lit(i).alias("template"), look.alias("look"))))
    met = F.filter(F.array(*out), lambda x: x.isNotNull())
    return about.select("__key", F.explode(met).alias("c")).select("__key", "c.*").distinct()


def _relative(nth: int, start: int):
    """The bit and relative position of a key phrase at a place; start: where it stands in its template."""
    return lambda p: F.struct(F.lit(32 + nth).cast("long").alias("bit"), (p - start).alias("delta"))


def aligned(texts: DataFrame, index: DataFrame, templates: tuple[Template, ...], looked_up: int = LOOKED_UP, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """__key, label, score, at: the labels of candidates (__key, text, template, look) with the share of words found, and
    the least relative position at which they were."""
    w = texts.withColumn("__w", words(F.col("text"))).drop("text")
    each = w.select("__key", "template", "look", F.posexplode("__w").alias("i", "word")).withColumn("bit", F.array_position("look", F.col("word")) - 1).where("bit >= 0")
    each = each.join(F.broadcast(index), ["template", "word"]).select("__key", "template", "bit", (F.col("i") - F.col("at")).alias("delta"))
    none = F.array().cast("array<struct<bit:bigint,delta:int>>")

    def key_places(x: Column) -> Column:
        """Of the row's template, the relative positions of its key phrases."""
        out = []
        for i, t in enumerate(templates):
            for k, phrase in enumerate(t.keys):
                start = len(f" {t.text} ".split(f" {phrase} ")[0].split())
                rows = F.transform(places(x, _spaced(x), phrase), _relative(k, start))
                out.append(F.when(F.col("template") == i, rows).otherwise(none))
        return F.concat(*out)

    keys = w.select("__key", "template", F.explode(bound(F.col("__w"), key_places)).alias("k")).select("__key", "template", "k.bit", "k.delta")
    both = each.union(keys).withColumn("grid", F.explode(F.array(F.lit(0), F.lit(slack)))).withColumn("band", F.expr(f"(delta + grid - pmod(delta + grid, {2 * slack})) div {2 * slack}"))
    found = both.groupBy("__key", "template", "grid", "band").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask"), F.min("delta").alias("at"))
    about = texts.sparkSession.createDataFrame([(i, t.label, ((1 << len(t.keys)) - 1) << 32, min(looked_up, len(set(t.text.split())))) for i, t in enumerate(templates)], "template int, label string, must long, words int")
    found = found.join(F.broadcast(about), "template").withColumn("score", F.bit_count(F.col("mask").bitwiseAND(F.lit((1 << 32) - 1))) / F.col("words"))
    found = found.where((F.col("mask").bitwiseAND(F.col("must")) == F.col("must")) & (F.col("score") >= share))
    return found.groupBy("__key", "label").agg(F.max("score").alias("score"), F.min("at").alias("at"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, looked_up: int = LOOKED_UP, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices (label, score, at of the
    method's labels). score: 1 with a base label, else the best of the method's, else 0."""
    if looked_up > 31:
        raise ValueError("at most 31 words can be looked up")
    for t in templates:
        for phrase in t.keys:
            if f" {phrase} " not in f" {t.text} ":
                raise ValueError(f"a template of {t.label} doesn't hold its key phrase {phrase!r}")
    phrases = PHRASES if phrases is None else phrases
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    about = written(based(docs, phrases, vocabulary), "based")
    seen = dict(about.select(F.explode("__held").alias("word")).groupBy("word").count().collect())  # a row a word of the templates
    rare = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    picked = written(candidates(about, templates, rare, looked_up), "candidates")
    texts = docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("__key"), "text")
    # a candidate has its template's rarest key word, which keeps most other texts out of the join
    first = sorted({min((w for k in t.keys for w in k.split()), key=rare.index) for t in templates}, key=rare.index)
    has_one = F.lit(False)
    for p in first:
        has_one = has_one | F.contains(F.translate("text", _UPPER, _LOWER), F.lit(p))
    rows = written(sized_join(texts.where(has_one), picked, "__key"), "texts")
    labels = aligned(rows, postings(docs.sparkSession, templates), templates, looked_up, slack, share)
    labels = labels.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("label", "score", "at"))).alias("notices"))  # a row a label
    labels = written(labels, "labels")
    out = sized_join(about.drop("__held"), labels, "__key", "left")
    none = F.array().cast("array<struct<label:string,score:double,at:int>>")
    mine = F.coalesce("notices", none)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("__base") > 0, 1.0).otherwise(F.coalesce(F.array_max(mine["score"]), F.lit(0.0)))
    for t in (picked, rows):
        drop_written(t)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("__base")).alias("base_labels"), joined(F.concat("__base", mine["label"])).alias("labels"), score.alias("score"), mine.alias("notices"))
