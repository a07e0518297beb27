"""License texts found by an exact set-similarity join, in DataFrame operations only.

Text blocks (paragraphs, parted by blank lines) are joined with license templates on the share of
the template's words they contain. All words of the templates are ordered by how many documents of
the corpus hold them, rarest first. A block that contains at least ``need`` of a template's m words
has one of its m - need + 1 rarest (prefix filter), has at least ``need`` template words at all
(length filter), and can still reach ``need`` after the first common word in that order (positional
filter). Only such pairs are counted out.

The templates are a bounded table: at most MAX_TEMPLATES of at most MAX_WORDS different words, which
is checked; so their word table may be broadcast. Texts and blocks are never shuffled, only the few
candidate pairs are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import ALNUM_WORD, col, lower_ascii, same

CONTAINMENT = 0.8
MAX_TEMPLATES, MAX_WORDS = 1000, 2000

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices of public licenses, and their labels.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version of the License, or at your option any later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ),
)

_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def _let(value: Column, build) -> Column:
    """``build(x)`` with x evaluated once."""
    return F.transform(F.array(value), build)[0]


def _places(words: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """(place, label) of every place where a phrase's words stand one after another."""
    def at(word: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in phrases:
            first, *rest = words_of(phrase)
            hit = word == first
            for k, w in enumerate(rest, 1):
                hit = hit & (F.get(words, i + k) == w)
            out = F.coalesce(F.when(hit, F.lit(label)), out)
        return F.struct(i.cast("bigint").alias("at"), out.alias("label"))

    return F.filter(F.transform(words, at), lambda p: p["label"].isNotNull())


def _maybe(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Whether a phrase can occur at all; spares most texts the search by words."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return text.rlike("|".join(gap.join(map(re.escape, words_of(p))) for p, _ in phrases))


def base_scan(docs: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """Add n_words and places, an array of (at, label) sorted by place; such columns are replaced.

    A null text has no words and no places.
    """
    keep = [col(c) for c in docs.columns if c.lower() not in ("n_words", "places")]
    lowered = lower_ascii(F.coalesce(col(text), F.lit("")))
    empty = F.array().cast("array<struct<at:bigint,label:string>>")
    found = F.when(_maybe(lowered, phrases), _let(words_column(col(text)), lambda w: _places(w, phrases))).otherwise(empty)
    return docs.select(*keep, F.regexp_count(lowered, F.lit(ALNUM_WORD)).cast("bigint").alias("n_words"), found.alias("places"))


def template_words(templates: Sequence[tuple[str, str]], containment: float) -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, words, words needed, the words) of every template that has a word."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    out = []
    for number, (label, text) in enumerate(templates):
        words = sorted(set(words_of(text)))
        if len(words) > MAX_WORDS:
            raise ValueError(f"template {number} has more than {MAX_WORDS} different words")
        if words:
            out.append((number, label, len(words), max(1, math.ceil(containment * len(words) - 1e-9)), words))
    return out


def word_frequencies(docs: DataFrame, text: str, vocabulary: Sequence[str]) -> DataFrame:
    """(word, df): in how many documents each word of a bounded vocabulary stands, 0 included."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    held = F.array_intersect(words_column(col(text)), F.array(*map(F.lit, vocabulary)))
    seen = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(seen, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))


def matches(
    docs: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(keys, block, label, share): every block whose word set holds the wanted share of a template's words.

    ``block`` counts the paragraphs of a text from 0; ``share`` is the exact containment.
    """
    spark, table = docs.sparkSession, template_words(templates, containment)
    schema = "template int, label string, size int, need int, words array<string>"
    described = spark.createDataFrame(table, schema)
    vocabulary = sorted({w for row in table for w in row[4]})
    if not vocabulary:
        return docs.select(*keys).limit(0).selectExpr(*[f"`{k}`" for k in keys], "0 AS block", "'' AS label", "0D AS share")
    # The global order: rarest words first. Bounded by the vocabulary, whatever the size of the corpus.
    ordered = [r["word"] for r in sorted(word_frequencies(docs, text, vocabulary).collect(), key=lambda r: (r["df"], r["word"]))]
    rank = {w: i for i, w in enumerate(ordered)}
    prefix = []
    for number, label, size, need, words in table:
        by_rank = sorted(words, key=rank.__getitem__)
        prefix += [(w, number, i) for i, w in enumerate(by_rank[: size - need + 1])]
    index = spark.createDataFrame(prefix, "word string, template int, position int")
    rare, every = sorted({w for w, _, _ in prefix}, key=rank.__getitem__), ordered
    blocks = docs.select(
        *[col(k) for k in keys], F.posexplode(F.split(F.coalesce(col(text), F.lit("")), r"\n[ \t\r\f]*(?:\n[ \t\r\f]*)+")).alias("block", "_b")
    )
    # array_intersect keeps the order of its first array: the block's template words, rarest first.
    common = F.array_intersect(F.array(*map(F.lit, every)), words_column(F.col("_b")))
    held = blocks.select(*[col(k) for k in keys], "block", common.alias("_common")).where(F.size("_common") > 0)
    probes = held.withColumn("_rare", F.array_intersect("_common", F.array(*map(F.lit, rare)))).where(F.size("_rare") > 0)
    probes = probes.select("*", F.explode("_rare").alias("word")).drop("_rare")
    pairs = probes.join(F.broadcast(index), "word").join(F.broadcast(described), "template")
    place = F.array_position("_common", F.col("word")) - 1
    left = F.least(F.size("_common") - place, F.col("size") - F.col("position"))
    shared = F.array_intersect("_common", "words")
    found = (
        pairs.where((F.size("_common") >= F.col("need")) & (left >= F.col("need") - F.col("position")))
        .withColumn("_shared", F.size(shared))
        # A pair meets at each of its common prefix words; it counts at the first of them.
        .where((F.col("_shared") >= F.col("need")) & (F.element_at(shared, 1) == F.col("word")))
    )
    return found.select(*[col(k) for k in keys], "block", "label", (F.col("_shared") / F.col("size")).alias("share"))


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per input row: doc_id, n_words, places, found (labels of matching templates) and share (the best one).

    Rows with equal doc_id and text get equal results, null ids included; null and empty texts have
    no words and no labels; an empty table gives no rows. No other column is looked at.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("h"), col(text).alias("text"))
    hits = matches(rows, ["doc_id", "h"], "text", templates, containment)
    best = hits.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("label")).alias("found"), F.max("share").alias("share"))
    best = best.toDF("_d", "_h", "found", "share")
    base = base_scan(rows, "text", phrases).drop("text")
    joined = base.join(best, same(base, best, [("doc_id", "_d"), ("h", "_h")]), "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "n_words", "places", F.coalesce("found", none).alias("found"), F.coalesce("share", F.lit(0.0)).alias("share"))


def op6_license_scan(docs: DataFrame) -> DataFrame:
    """Score: 1 where a phrase stands, else the best containment of a matching block, else 0."""
    base = F.array_sort(F.array_distinct(F.col("places")["label"]))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.col("places")["at"]).alias("first_word"),
        F.array_max(F.col("places")["at"]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("found"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("share")).alias("score"),
    )


def _sql() -> str:
    wanted = ", ".join(
        f"({n}, '{label}', {need}, {size}, [{', '.join(repr(w) for w in words)}])"
        for n, label, size, need, words in template_words(TEMPLATES, CONTAINMENT)
    )
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    lowered = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = ALNUM_WORD
    return rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all({lowered.format('text')}, '{pattern}') AS ws FROM documents),
phrases(p, label, size) AS (VALUES {phrases}),
places AS (SELECT doc_id, ws, unnest(range(0, len(ws)::BIGINT)) AS i FROM w WHERE len(ws) > 0),
base AS (SELECT doc_id, i, label FROM places, phrases WHERE array_to_string(ws[i + 1:i + size], ' ') = p),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY doc_id),
templates(n, label, need, size, words) AS (VALUES {wanted}),
blocks AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n[ \t\r\f]*(?:\n[ \t\r\f]*)+')) AS b FROM w),
sets AS (SELECT doc_id, list_distinct(regexp_extract_all({lowered.format('b')}, '{pattern}')) AS s FROM blocks),
m AS (SELECT doc_id, label, size, need, len(list_intersect(words, s)) AS shared FROM sets, templates),
found AS (SELECT doc_id, label, shared::DOUBLE / size AS share FROM m WHERE shared >= need),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS ls FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS ls
    FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
    coalesce(bl.ls, '') AS base_labels, coalesce(al.ls, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN bl ON bl.doc_id = w.doc_id LEFT JOIN al ON al.doc_id = w.doc_id
    LEFT JOIN best ON best.doc_id = w.doc_id
"""


OP6_SQL = _sql()
