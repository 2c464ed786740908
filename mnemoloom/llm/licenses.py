"""License phrases and notices by an exact set-similarity join. DataFrame functions only.

A text is a sequence of overlapping word blocks; a template (a phrase or a notice) is a set of words. A block matches a template
if it holds ``k`` of its words at least, ``k`` being the containment threshold times their number. Words have one global order, rarest in
the corpus first. Of any pair that matches, the first common word is among the first ``m - k + 1`` words of the template (prefix filter),
the block holds ``k`` words of templates or more (length filter), and ``k - 1`` common words can still follow that word on both
sides (positional filter); pairs that pass are counted exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoloom.llm.urlfilter import LOWER, UPPER

WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a longer list of templates, so many distinct words at most are searched for in one pass; the other templates take further passes.
PASS_WORDS = 2000

#: Fixed values: (label, phrase); a phrase counts where its words stand one after another.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: Fixed values: (label, wording) of public license notices.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), "")


def template_list(phrases: list[tuple[str, str]], notices: list[tuple[str, str]], percent: int) -> list[dict]:
    """Templates as dictionaries: label, words in their order, k (the words that a block must have), whether it is a phrase."""
    out = []
    for is_phrase, pairs in ((True, phrases), (False, notices)):
        for label, text in pairs:
            found = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
            if not found:
                raise ValueError(f"a template without words: {text!r}")
            n = len(set(found))
            out.append({"label": label, "words": found, "k": n if is_phrase else max(1, math.ceil(percent * n / 100)), "phrase": is_phrase})
    return out


def passes(templates: list[dict], limit: int) -> list[list[dict]]:
    """Templates in lists whose distinct words number ``limit`` at most (but for one template that has more)."""
    out, known = [[]], set()
    for t in templates:
        if out[-1] and len(known | set(t["words"])) > limit:
            out.append([])
            known = set()
        out[-1].append(t)
        known |= set(t["words"])
    return out


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each word of the templates stands in all texts; as many numbers as the templates have words."""
    known = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string"))
    counted = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).join(known, "word", "left_semi").groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def _matches(spark: SparkSession, rows: DataFrame, templates: list[dict], order: dict[str, tuple], span: int) -> DataFrame:
    """One row or more for each text, with its matches: label, share (of the template's words), places (of a phrase)."""
    vocabulary = sorted({w for t in templates for w in t["words"]}, key=order.__getitem__)
    prefixes = []
    for t in templates:
        ranked = sorted(set(t["words"]), key=order.__getitem__)
        prefixes += [(w, j, len(ranked), t["k"], t["label"], t["phrase"], t["words"], ranked) for j, w in enumerate(ranked[: len(ranked) - t["k"] + 1])]
    table = F.broadcast(spark.createDataFrame(prefixes, "word string, j int, m int, k int, label string, phrase boolean, wording array<string>, ranked array<string>"))
    ranked = F.array(*(F.lit(w) for w in vocabulary))
    heads = sorted({p[0] for p in prefixes})
    rows = rows.withColumn("last", F.greatest(F.ceil(F.size("words") / span) - 2, F.lit(0)))
    heard = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(heads), i.cast("long"))))
    numbers = F.array_distinct(F.flatten(F.transform(heard, lambda i: F.array(F.least(F.floor(i / span), F.col("last")), F.least(F.greatest(F.floor(i / span) - 1, F.lit(0)), F.col("last"))))))
    windows = F.transform(numbers, lambda b: F.struct((b * span).alias("start"), F.when(b == F.col("last"), 2 * span).otherwise(span).alias("owns"), F.slice("words", (b * span + 1).cast("int"), 2 * span).alias("words")))
    blocks = F.transform(windows, lambda x: F.struct(x["start"].alias("start"), x["owns"].alias("owns"), x["words"].alias("words"), F.array_intersect(ranked, x["words"]).alias("own")))
    held = rows.select("row", "doc_id", "n_words", F.explode_outer(blocks).alias("block"))
    probes = held.select("row", "doc_id", "n_words", "block", F.posexplode_outer("block.own").alias("i", "word"))
    pairs = probes.join(table, "word", "left")
    possible = (F.size("block.own") >= F.col("k")) & (1 + F.least(F.size("block.own") - F.col("i") - 1, F.col("m") - F.col("j") - 1) >= F.col("k"))
    common = F.when(possible, F.array_intersect("block.own", "ranked"))
    tested = pairs.select("row", "doc_id", "n_words", "block", "word", "label", "phrase", "wording", "m", "k", common.alias("common"))
    meets = (F.size("common") >= F.col("k")) & (F.get("common", F.lit(0)) == F.col("word"))
    stands = F.transform(F.sequence(F.lit(1), F.least(F.size("block.words"), F.col("block.owns"))), lambda p: F.when(F.slice("block.words", p, F.size("wording")) == F.col("wording"), F.col("block.start") + p - 1))
    places = F.when(meets & F.col("phrase"), F.array_compact(stands))
    found = tested.select("row", "doc_id", "n_words", "label", F.when(meets & ~F.col("phrase"), F.size("common") / F.col("m")).alias("share"), places.alias("places"))
    return found.select("row", "doc_id", "n_words", "places", F.when(F.size("places") > 0, F.col("label")).alias("base"), F.when((F.size("places") > 0) | F.col("share").isNotNull(), F.col("label")).alias("label"), F.when(F.size("places") > 0, 1.0).otherwise(F.col("share")).alias("share"))


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of all ``phrases``, first_word and last_word are the least and the greatest of their starts (words from 0;
    null without any), base_labels the phrases' labels, labels those and the labels of every notice of whose words a block holds ``percent`` or
    more; both are distinct, sorted and joined by commas, empty without any. The score is 1 where a phrase stands, else the largest share of a
    notice's words in a block that matches it, else 0. A block is twice as long as the longest template and starts every template's length,
    so that whatever is as long as a template lies in one block as a whole.

    Defined cases: null, empty or wordless texts have no words and no labels; null ids and repeated rows are each judged; extra columns are
    ignored whatever their names; an empty table gives no rows.

    Scale: words of all texts are counted against the templates' words (combined before their small shuffle). Blocks are arrays inside
    their row, and only those with a word of a template's prefix are unfolded to meet the templates, which are broadcast (``pass_words``
    distinct words a pass at most, further passes for longer lists). A text's rows stay in its partition up to the grouped
    result, complete before the shuffle, so no phrase or word is a key and one row a text moves.
    """
    templates = template_list(phrases, notices, percent)
    words = sorted({w for t in templates for w in t["words"]})
    counts = word_counts(docs, words, text_col)
    order = {w: (counts.get(w, 0), w) for w in words}
    span = max(len(t["words"]) for t in templates)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words")).withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("long"))
    found = None
    for some in passes(templates, pass_words):
        part = _matches(docs.sparkSession, rows, some, order, span)
        found = part if found is None else found.unionByName(part)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    grouped = found.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.greatest(F.size("places"), F.lit(0))), F.lit(0)).alias("n_base"), F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        listed("base").alias("base_labels"), listed("label").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return grouped.drop("row")


def scan_sql(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, percent: int = 80) -> str:
    """DuckDB SQL over ``documents`` with the same rows, by the definition: phrases in whole texts, notices against every block."""
    templates = template_list(phrases, notices, percent)
    span = max(len(t["words"]) for t in templates)
    values = ", ".join(f"('{t['label']}', {t['words']}, {t['k']}, {len(set(t['words']))}, {t['phrase']})" for t in templates)
    return rf"""
        WITH t(label, tw, k, m, phrase) AS (VALUES {values}),
        w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS ws FROM documents),
        p AS (SELECT r, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1] = tw[1] AND ws[i + 1 : i + len(tw)] = tw)) AS pos FROM w JOIN t ON phrase),
        b AS (SELECT r, ws[{span} * x + 1 : {span} * x + {2 * span}] AS bw FROM w, unnest(range(0, greatest(ceil(len(ws) / {span}.0)::BIGINT - 1, 1))) u(x)),
        c AS (SELECT r, label, m, k, len(list_intersect(list_distinct(tw), bw)) AS n FROM b JOIN t ON NOT phrase),
        f AS (SELECT r, label, pos, label AS base, 1.0::DOUBLE AS share FROM p UNION ALL SELECT r, label, NULL, NULL, n / m FROM c WHERE n >= k),
        g AS (SELECT r, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(base))) AS bl, list_sort(list_distinct(list(label))) AS ll, max(share) AS share FROM f GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(ll, ','), '') AS labels, coalesce(share, 0) AS score
        FROM w LEFT JOIN g USING (r)"""
