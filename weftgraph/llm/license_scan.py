"""License scan by diagonal voting.

All rolling word k-gram hashes of all texts are joined by Spark to the positions of the
templates' k-grams. A hit of document position p on template position q votes for the
diagonal p - q; votes are aggregated by diagonal, and neighbouring diagonals (words added to
or missing from a copy shift it) are merged into a span, across gaps of up to half of the
template. A span is verified by the template's words that its hits cover: they must be a given
share of all, they must hold the phrase that tells the license from its relatives (its name,
version or clauses) without a gap, and among its hits must be a k-gram that no rival has. A
rival is a template of another label that has a third of the template's k-grams or more.
Base phrases use k = 2 and must be covered whole on one diagonal; notices of up to 14 words
use k = 3, longer templates k = 5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LETTERS, LOWER, Scratch, gram_hashes, signed, steps, within, word_hashes, word_spans

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices and opening paragraphs of public licenses, and their labels.
# NEEDED below has the words that tell a license from its relatives.
TEMPLATES = (
    ("licensed under the GNU General Public License, version 3", "gpl-3"),
    ("licensed under the GNU General Public License, version 2", "gpl-2"),
    ("licensed under the GNU Lesser General Public License", "lgpl"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Released under the MIT License", "mit-notice"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "gpl-3",
    ),
    (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "gpl-2",
    ),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "lgpl",
    ),
    (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "apache-2.0",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/",
        "mpl-2.0",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose",
        "unlicense",
    ),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
)

# Phrases that must stand in a span as they do in the template, whatever share of the rest is there; the first entry whose phrases a template has counts.
NEEDED = (
    ("gnu general public license", "version 3"),
    ("gnu general public license", "version 2"),
    ("gnu lesser general public license",),
    ("apache", "version 2 0"),
    ("cc by nc sa 4 0",),
    ("cc by nc 4 0",),
    ("cc by sa 4 0",),
    ("creative commons attribution 4 0 international",),
    ("mit license",),
    ("licenses license 2 0",),
    ("mozilla public license v 2 0",),
)

#: Words of the grams of base phrases, of notices of up to NOTICE words, and of longer templates.
SHORT, MIDDLE, LONG = SIZES = 2, 3, 5
NOTICE = 14
#: A row of every document, so that documents without hits come through the join too.
_ALWAYS = 0


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, data, offsets in steps(pa.array(texts)):
        data = LOWER[data]
        starts, ends, rows = word_spans(data, offsets, LETTERS)
        h = word_hashes(data, starts, ends)
        out += [h[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
    return out


def template_positions(templates=TEMPLATES, base=BASE) -> list[tuple]:
    """(hash, template, position, k, words of the template, label, base?, own?) of all template k-grams.

    own: no rival template has the k-gram; base phrases have no rivals.
    """
    rows = [(_ALWAYS, -1, 0, 0, 0, None, False, False)]
    texts = [t for t, _ in (*base, *templates)]
    found = []
    for number, ((_, label), words) in enumerate(zip((*base, *templates), _word_hashes(texts), strict=True)):
        k = SHORT if number < len(base) else MIDDLE if len(words) <= NOTICE else LONG
        found.append((k, len(words), label, signed(gram_hashes(words, k)).tolist()))
    for number, (k, total, label, grams) in enumerate(found):
        is_base, theirs = number < len(base), set()
        if not is_base:
            others = [set(g) for j, name, g in ((x[0], x[2], x[3]) for x in found[len(base) :]) if j == k and name != label]
            theirs = set().union(*(o for o in others if 3 * len(o & set(grams)) >= len(set(grams))))
        rows += [(h, number, q, k, total, label, is_base, h not in theirs) for q, h in enumerate(grams)]
    return rows


def needed_pairs(templates=TEMPLATES, base=BASE, needed=NEEDED) -> list[tuple]:
    """(template, pairs): the words [lo, hi), one or two neighbours, of the template's needed phrases that a matched gram must cover together."""
    texts = [w.tolist() for w in _word_hashes([t for t, _ in (*base, *templates)])]
    entries = [[w.tolist() for w in _word_hashes(list(phrases))] for phrases in needed]
    out = [(number, []) for number in range(len(base))]
    for number, words in enumerate(texts[len(base) :], len(base)):
        pairs: list[tuple] = []
        for phrases in entries:
            places = [next((i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p), None) for p in phrases]
            if None not in places:
                pairs = [(at + i, at + min(i + 2, len(p))) for at, p in zip(places, phrases, strict=True) for i in range(max(1, len(p) - 1))]
                break
        out.append((number, pairs))
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_words, hashes): of each text the mark _ALWAYS, then its k-grams in order, for each k of SIZES."""
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
    for batch in batches:
        for at, data, offsets in steps(batch.column(1)):
            n = len(offsets) - 1
            data = LOWER[data]
            starts, ends, rows = word_spans(data, offsets, LETTERS)
            words = word_hashes(data, starts, ends)
            count = np.diff(rows)
            sizes = 1 + sum(np.maximum(count - k + 1, 0) for k in SIZES)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.zeros(cuts[-1], np.int64)
            shift = cuts[:-1] + 1
            for k in SIZES:
                own = np.maximum(count - k + 1, 0)
                ok = within(rows, k, len(words))
                good = signed(gram_hashes(words, k)[ok])
                place = np.repeat(shift - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(len(good))
                flat[place] = good
                shift = shift + own
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))
            ids = pa.array(np.arange(number, number + n))
            number += n
            yield pa.RecordBatch.from_arrays([ids, batch.column(0).slice(at, n), pa.array(count.astype(np.int64)), lists], names=["row", "doc_id", "n_words", "hashes"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE, coverage: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): one row per row of docs, and one row per verified span.

    documents: row, doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the best coverage of a span, 0 without spans). spans: row, doc_id, label,
    is_base, start and end (words from 0, end exclusive), coverage (the share of the
    template's words that hits cover).

    A span counts if its hits cover enough of the template's words, one of them is a k-gram
    that no rival has, and all of the template's needed phrases (NEEDED) are covered by hits
    without a gap. Hits are k-grams of equal 64-bit hashes; the texts are not read again.

    Null and empty texts have no words. Texts of any length are read whole, one at a time.
    Repeated rows are rows of their own; a null id stays null. Ties: every place of a base
    phrase counts, overlapping ones too, and spans of several templates stand side by side.
    Other columns are not read; an empty table gives empty results. The template table is
    the only thing broadcast; its size is that of the templates given.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grams = source.mapInArrow(_grams, "row long, doc_id long, n_words long, hashes array<long>")
    columns = "hash long, template int, q int, k int, total int, label string, is_base boolean, own boolean"
    table = spark.createDataFrame(template_positions(templates, base), columns)
    hits = grams.select("row", "doc_id", "n_words", F.posexplode("hashes").alias("i", "hash")).join(F.broadcast(table), "hash")
    # Where the k-grams of this k begin in the list: after the mark and the smaller grams. A hash that meets a template of another k is no hit.
    before, after = F.lit(1).cast("long"), F.lit(1).cast("long")
    at = F.lit(0).cast("long")
    fits = F.col("template") < 0
    for k in SIZES:
        after = before + F.greatest(F.lit(0), F.col("n_words") - k + 1)
        fits = fits | (F.col("k") == k) & (F.col("i") >= before) & (F.col("i") < after)
        at = F.when(F.col("k") == k, F.col("i") - before).otherwise(at)
        before = after
    votes = (
        hits.filter(fits)
        .withColumn("diagonal", F.when(F.col("template") < 0, F.lit(0)).otherwise(at - F.col("q")))
        .groupBy("row", "doc_id", "n_words", "template", "diagonal", "k", "total", "label", "is_base")
        .agg(F.collect_set("q").alias("qs"), F.max("own").alias("own"))  # a diagonal meets each template position once
    )
    votes = scratch.write(votes, "votes")
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.greatest(F.lit(3), F.expr("total div 2"))
    new = F.col("is_base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    words = F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + F.col("k") - 1))))
    spans = (
        votes.filter("template >= 0")
        .withColumn("new", F.when(new, 1).otherwise(0))
        .withColumn("span", F.sum("new").over(order))
        .groupBy("row", "doc_id", "template", "label", "is_base", "total", "k", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("qs"))).alias("qs"),
            F.max("own").alias("own"),
            F.min(F.col("diagonal") + F.array_min("qs")).alias("start"),
            F.max(F.col("diagonal") + F.array_max("qs") + F.col("k")).alias("end"),
        )
        .withColumn("coverage", F.size(words) / F.col("total"))
        .join(F.broadcast(spark.createDataFrame(needed_pairs(templates, base), "template int, pairs array<struct<lo:int,hi:int>>")), "template")
        .filter("forall(pairs, p -> exists(qs, q -> q <= p.lo and q + k >= p.hi))")
        .filter("if(is_base, size(qs) = total - k + 1, own and coverage >= %r)" % coverage)
        .select("row", "doc_id", "label", "is_base", "start", "end", "coverage")
    )
    spans = scratch.write(spans, "spans")
    found = spans.groupBy("row").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    whole = votes.filter("template < 0").select("row", "doc_id", "n_words").join(found, "row", "left")
    whole = scratch.write(whole.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}), "documents")
    scratch.drop("votes")
    return whole, spans


#: The base columns by lists of words.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
p(phrase, label) AS (VALUES %s),
h AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(words) - len(phrase) + 1), lambda i: words[i + 1:i + len(phrase)] = phrase)) AS pos
  FROM w, p),
g AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM h GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM w.doc_id
""" % ", ".join(f"({phrase.split()}, '{label}')" for phrase, label in BASE)
