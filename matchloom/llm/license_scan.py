"""License texts in documents: an exact set-similarity join of text blocks and templates.

A block is BLOCK_WORDS consecutive words of a document and begins at every STRIDE-th
word, so every run of STRIDE + 1 words lies in a block whole.  A template is a license
clause of at most STRIDE words.  A block matches where it holds at least THRESHOLD of
the template's distinct words (a phrase: all of them, and consecutively).

The join is exact.  Words are ordered by how often all documents use them, rarest
first.  Two sets with ``need`` words in common share one among the first
``size - need + 1`` of each (prefix), both have ``need`` words (length), and what is left
after the first common word must suffice (position).  The rest is counted.  Words
that no template has cannot be common and are left out of a block first.

All of it is built-in functions; the one shuffle is of one short row a document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import free_name

BLOCK_WORDS, STRIDE = 64, 32
THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Clauses of public licenses, and short notices that name one.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[str]:
    """Words of a template: as those of documents, A-Z lower-cased."""
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def _clauses(templates: Sequence[tuple[str, str]], phrases: Mapping[str, str], threshold: float) -> list[dict]:
    """Rules of the join: clauses of at most STRIDE words, and phrases that need all words."""
    out = [{"label": label, "words": words_of(phrase), "share": 1.0, "phrase": True} for phrase, label in phrases.items()]
    for label, text in templates:
        words = words_of(text)
        out += [{"label": label, "words": words[i : i + STRIDE], "share": threshold, "phrase": False} for i in range(0, len(words), STRIDE)]
    for k, rule in enumerate(out):
        rule |= {"rule": k, "tokens": sorted(set(rule["words"]))}
        rule["need"] = max(1, math.ceil(rule["share"] * len(rule["tokens"]) - 1e-9))
        if not rule["words"] or len(rule["words"]) > STRIDE:
            raise ValueError("a phrase has 1 to %d words" % STRIDE)
    return out


def _words(text: Column) -> Column:
    # U+212A is the one character whose lower case is a letter of a-z alone.
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), F.lit(WORD), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def rarest_first(docs: DataFrame, tokens: Sequence[str], text_col: str = "text") -> list[str]:
    """``tokens`` by their number of places in all documents, ties by the token itself.

    What comes to the driver is bounded by the templates' own words.
    """
    places = docs.select(F.explode(_words(F.col(text_col))).alias("token")).where(F.col("token").isin(*tokens)).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in places.collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def _index(docs: DataFrame, rules: list[dict], order: list[str]) -> DataFrame:
    """One row for each word in a template's prefix; its size is that of the templates."""
    rank = {t: k for k, t in enumerate(order)}
    rows = []
    for r in rules:
        tokens = sorted(r["tokens"], key=rank.__getitem__)
        for at, token in enumerate(tokens[: len(tokens) - r["need"] + 1]):
            rows.append(F.struct(
                F.lit(token).alias("token"), F.lit(at).alias("t_at"), F.lit(len(tokens)).alias("t_size"), F.lit(r["need"]).alias("need"), F.lit(r["rule"]).alias("rule"),
                F.lit(r["label"]).alias("label"), F.lit(r["phrase"]).alias("phrase"), _strings(tokens).alias("t_tokens"), _strings(r["words"]).alias("t_words"),
            ))
    return docs.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _joined(docs: DataFrame, rules: list[dict], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_words, start, ...): a row of start -1 for every document, and
    one for every place of a prefix word, with the rule that its block matches or null."""
    order = rarest_first(docs, sorted({t for r in rules for t in r["tokens"]}), text_col)
    rank = {t: k for k, t in enumerate(order)}
    prefix = sorted({t for r in rules for t in sorted(r["tokens"], key=rank.__getitem__)[: len(r["tokens"]) - r["need"] + 1]})
    block = lambda i: F.struct(i.cast("long").alias("start"), F.slice("words", i + 1, BLOCK_WORDS).alias("b_words"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), _words(F.col(text_col)).alias("words"))
    blocks = texts.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
        F.inline(F.concat(
            F.array(F.struct(F.lit(-1).cast("long").alias("start"), _strings([]).alias("b_words"))),
            F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRIDE)), block), lambda b: F.arrays_overlap(b["b_words"], _strings(prefix))),
        )),
    )
    ranked = blocks.withColumn("b_tokens", F.array_intersect(_strings(order), F.col("b_words")))
    each = ranked.select("*", F.size("b_tokens").alias("b_size"), F.posexplode_outer("b_tokens").alias("b_at", "token"))
    left = lambda size, at: F.col(size) - F.col(at)
    near = (
        (F.col("b_size") >= F.col("need"))  # length
        & (left("b_size", "b_at") >= F.col("need"))  # prefix of the block, and what is left of either side
        & (left("t_size", "t_at") >= F.col("need"))
    )
    index = F.broadcast(_index(docs, rules, order).withColumnRenamed("token", "t_token"))
    pairs = each.join(index, (F.col("token") == F.col("t_token")) & near, "left")
    first = F.size(F.array_intersect(F.slice("b_tokens", 1, F.col("b_at")), F.col("t_tokens"))) == 0
    common = F.size(F.array_intersect("b_tokens", "t_tokens"))
    k = F.size("t_words")
    # A phrase counts where it begins in the block's own part; the rest is the next block's.
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.least(F.size("b_words") - k, F.lit(STRIDE - 1)), F.lit(0))), lambda i: F.slice("b_words", i + 1, k) == F.col("t_words"))
    out = pairs.withColumn("found", F.coalesce(first & (common >= F.col("need")), F.lit(False)))
    out = out.withColumn("places", F.when(F.col("found") & F.col("phrase"), at))
    found = F.col("found") & (~F.col("phrase") | (F.size("places") > 0))
    return out.select("doc_id", "text_hash", "n_words", "start", "rule", "label", "phrase", "places", found.alias("found"), (common / F.col("t_size")).alias("containment"), F.size("b_words").alias("b_count"))


def license_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, rule, label, phrase, containment): every matching block, words from 0, end exclusive.

    Rules are numbered: the phrases, then the templates' clauses.
    """
    rows = _joined(docs, _clauses(templates, phrases, threshold), id_col, text_col).where("found")
    return rows.select("doc_id", "start", (F.col("start") + F.col("b_count")).alias("end"), "rule", "label", "phrase", "containment")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: places of phrases, labels, and the greatest containment found (0: none).

    ``base_labels`` are the phrases', ``labels`` also the templates', both sorted.  A null or
    empty text has no words and no label.  Texts of any length are taken whole.  Rows that
    repeat an id and a text come out as often as they come in; several labels with equal
    containment all count.  An empty table gives an empty one; further columns are ignored.
    """
    rules = _clauses(templates, phrases, threshold)
    labels = sorted({r["label"] for r in rules})
    if len(labels) > 62:
        raise ValueError("at most 62 labels")
    rows = _joined(docs, rules, id_col, text_col)
    bit = F.coalesce(*[F.when(F.col("label") == label, F.lit(1 << k).cast("long")) for k, label in enumerate(labels)])
    place = lambda f: F.when(F.col("found"), F.col("start") + f(F.col("places")))
    per = rows.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(F.col("start") < 0).alias("copies"),
        F.sum(F.when(F.col("found") & F.col("phrase"), F.size("places")).otherwise(0)).alias("n_base"),
        F.min(place(F.array_min)).alias("first_word"), F.max(place(F.array_max)).alias("last_word"),
        F.bit_or(F.when(F.col("found") & F.col("phrase"), bit).otherwise(F.lit(0).cast("long"))).alias("base_bits"), F.bit_or(F.when(F.col("found"), bit).otherwise(F.lit(0).cast("long"))).alias("bits"),
        F.max(F.when(F.col("found"), F.col("containment")).otherwise(0.0)).alias("score"),
    )
    named = lambda bits: F.concat_ws(",", *[F.when(F.col(bits).bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(label)) for k, label in enumerate(labels)])
    one = free_name(per, "one")
    # Equal rows were counted together; a repeated phrase count is that of one of them.
    per = per.withColumn("n_base", F.expr("n_base div copies")).withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return per.select("doc_id", "n_words", F.col("n_base").cast("long"), "first_word", "last_word", named("base_bits").alias("base_labels"), named("bits").alias("labels"), "score")


def scan_sql() -> str:
    """The result in DuckDB SQL, every block against every rule."""
    rules = _clauses(TEMPLATES, PHRASES, THRESHOLD)
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    values = ", ".join(f"('{r['label']}', {r['phrase']}, {r['need']}, {quoted(r['tokens'])}, {quoted(r['words'])})" for r in rules)
    return f"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    rules(label, phrase, need, tokens, words) AS (VALUES {values}),
    blocks AS (SELECT r, w[i + 1 : i + {BLOCK_WORDS}] AS b FROM (SELECT r, w, unnest(range(0, len(w), {STRIDE})) AS i FROM w)),
    near AS (SELECT r, label, len(list_intersect(tokens, b)) / len(tokens) AS share FROM blocks, rules WHERE NOT phrase AND len(list_intersect(tokens, b)) >= need),
    base AS (SELECT r, label, i FROM (SELECT r, w, label, words, unnest(range(0, len(w) - len(words) + 1)) AS i FROM w, rules WHERE phrase AND len(w) >= len(words)) WHERE w[i + 1 : i + len(words)] = words),
    b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
    l AS (SELECT r, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT * FROM near UNION ALL SELECT r, label, 1.0 FROM base) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM w LEFT JOIN b USING (r) LEFT JOIN l USING (r)
    """
