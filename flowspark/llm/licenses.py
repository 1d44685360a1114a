"""License scan: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

DataFrame operations only. A text that speaks of a license gives notice blocks (``blocks``): its SPDX identifiers, the whole
text, its runs of paragraphs that speak of a license, each such paragraph, and such lines with those after them. Each block is
a vector of its own, and the widest kind that reaches the threshold decides. Equal texts and equal blocks are weighed once;
document frequencies come from all paragraphs that speak of a license. Files without a license of their own take that of the
licence file in the nearest directory above them, found by joins on distinct directory paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.license_texts import SPDX, TEXTS
from flowspark.llm.salted import salted_join
from flowspark.session import durable

# between two words of a mark there can be a line's end and a comment's signs
_MARK = r"licen|copyright|spdx|hereby\W+granted|permission\W+to\W+use|redistribution\W+and\W+use|public\W+domain|unencumbered|software\W+is\W+provided"
MARKS = f"(?i)(?:{_MARK})"
SPDX_TAG = "SPDX-License-Identifier:"
#: Kinds of blocks, from the one that decides first.
IDENTIFIER, WHOLE, RUN, PARAGRAPH, LINES = range(5)
#: Lines that a window from a line with a mark holds at most.
WINDOW = 4

# Wording by which public licenses are announced.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright. All rights reserved."),
    *TEXTS,
    *[(name, f"{SPDX_TAG} {identifier}") for name, identifier in SPDX],
)


def _speaks(text: Column) -> Column:
    return text.rlike(MARKS)


def notice(text: Column) -> Column:
    """The lines of a text that speak of a license, as one string; null where there is none."""
    lines = F.filter(F.split(text, "\n"), _speaks)
    return F.when(_speaks(text), F.array_join(lines, "\n"))


def _body(text: Column) -> Column:
    """The text without SPDX and copyright lines, with an empty line where a comment begins or ends."""
    comment = r"[ \t]*(?:#|//|;|--|%|(?:dnl|rem)\b)"
    for pattern, new in (
        (r"\r\n?", "\n"),
        (r"(?im)^[^\n]*spdx-license-identifier:[^\n]*$", ""),
        (r"(?im)^[^\p{L}\p{N}\n]*(?:(?:copyright|c\))\s*(?:\(c\)|©|\d|(?-i:[A-Z]))|all\s+rights\s+reserved\W*$)[^\n]*$", ""),
        (r"/\*|\*/|<!--|-->|\"\"\"|\x27\x27\x27", "\n\n"),
        (rf"(?im)^({comment}[^\n]*)\n(?!{comment})", "$1\n\n"),
        (rf"(?im)^(?!{comment})([^\n]+)\n(?={comment})", "$1\n\n"),
        (r"(?im)^[ \t]*(?:dnl|rem)\b", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def blocks(text: Column) -> Column:
    """Array of structs (kind, words, size) of the notice blocks of a text that speaks of a license; size in characters.

    An SPDX expression gives one block for each of its identifiers, without exceptions.
    """
    said = F.flatten(F.transform(
        F.regexp_extract_all(text, F.lit(r"(?i)spdx-license-identifier:([^\n]*)"), F.lit(1)),
        lambda x: F.split(F.regexp_replace(x, r"(?i)\s+with\s+[^\s()]+", ""), r"(?i)[\s)]+(?:and|or)[\s(]+"),
    ))
    ids = F.filter(F.transform(said, lambda x: F.regexp_extract(x, r"[\p{L}\p{N}.+\-]*[\p{L}\p{N}][\p{L}\p{N}.+\-]*", 0)), lambda x: x != "")
    body = _body(text)
    parts = F.split(body, r"\n(?:[^\p{L}\p{N}\n]*\n)+")
    runs = F.split(F.array_join(F.transform(parts, lambda p: F.when(_speaks(p), p).otherwise("\0")), "\n"), "\0")
    windows = [F.regexp_extract_all(body, F.lit(rf"(?im)^(?=((?:[^\n]*\n){{0,{k}}}[^\n]*))[^\n]*(?:{_MARK})"), F.lit(1)) for k in range(WINDOW)]

    def of(kind: int, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("words"), F.length(x).alias("size")))

    found = F.concat(
        of(IDENTIFIER, F.transform(ids, lambda x: F.concat(F.lit(f"{SPDX_TAG} "), x))),
        F.array(F.struct(F.lit(WHOLE).alias("kind"), body.alias("words"), F.length(text).alias("size"))),
        of(RUN, runs), of(PARAGRAPH, F.filter(parts, _speaks)), of(LINES, F.array(notice(text))), *[of(LINES, w) for w in windows],
    )
    return F.filter(found, lambda b: b["words"].rlike(r"[\p{L}\p{N}]"))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.\-+]+"), lambda x: F.regexp_replace(x, r"[.\-+]+", "") != "")


def _plain(term: Column) -> Column:
    return F.regexp_replace(term, r"[.\-+]+$", "")


def words(text: Column) -> Column:
    return F.transform(_terms(text), _plain)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, words string")


def match_notices(notices: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(_b, license, similarity) of the distinct blocks (columns ``_b``, ``terms``, ``n``) that reach the threshold.

    (1 + ln tf) * idf with idf = ln((1 + N) / (1 + df)) + 1 over N notices (each block counts ``n`` times) and all templates; a
    term of no template counts as if it were in one notice. Equal similarities go to the license whose name sorts first.
    """
    weigh = 1 + F.log(F.count("*"))
    terms = notices.select("_b", "n", F.explode("terms").alias("term")).groupBy("_b", "n", "term").agg(weigh.alias("tf"))
    model = templates.select("template", "license", F.explode(words(F.col("words"))).alias("term"))
    model = model.groupBy("template", "license", "term").agg(weigh.alias("m"))
    vocabulary = model.groupBy("term").agg(F.countDistinct("template").alias("own"))
    total = notices.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files")).crossJoin(F.broadcast(templates.agg(F.count("*").alias("own")))).select((F.col("files") + F.col("own")).alias("total"))
    counted = terms.groupBy("term").agg(F.sum("n").alias("files"))
    # as many rows as the templates have terms
    idf = vocabulary.join(counted, "term", "left").crossJoin(F.broadcast(total)).select(
        "term", (F.log((1 + F.col("total")) / (1 + F.coalesce("files", F.lit(0)) + F.col("own"))) + 1).alias("idf")
    )
    rare = total.select((F.log((1 + F.col("total")) / F.lit(2.0)) + 1).alias("rare"))
    weights = model.join(F.broadcast(idf), "term").withColumn("w", F.col("m") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    known = F.broadcast(idf)
    vector = terms.join(known, "term", "left").crossJoin(F.broadcast(rare)).select("_b", "term", (F.col("tf") * F.coalesce("idf", "rare")).alias("v"), F.col("idf").isNotNull().alias("known"))
    square = F.col("v") * F.col("v")
    lengths = vector.groupBy("_b").agg(F.sqrt(F.sum(square)).alias("length"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("reach"))
    # no cosine is above the share of the length that lies in terms of templates
    able = lengths.filter(F.col("reach") >= (threshold - 1e-6) * F.col("length")).drop("reach")
    table = weights.join(F.broadcast(norms), "template").select("term", "template", "license", (F.col("w") / F.col("norm")).alias("w"))
    dots = vector.filter("known").join(able, "_b").join(F.broadcast(table), "term").groupBy("_b", "length", "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    best = (
        dots.select("_b", "license", F.round(F.col("dot") / F.col("length"), 9).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
        .groupBy("_b")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    )
    return best.select("_b", "b.license", (-F.col("b.s")).alias("similarity"))


def match_texts(texts: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(_k, license, similarity, share) of the distinct texts (columns ``_k``, ``text``, ``n`` files each) with a license.

    The first kind of block that reaches the threshold decides, in it the most similar one; share is that block's part of the text.
    """
    found = texts.select("_k", "n", F.length("text").alias("chars"), F.explode(blocks(F.col("text"))).alias("x"))
    found = found.select("_k", "n", "x.kind", (F.col("x.size") / F.col("chars")).alias("share"), words(F.col("x.words")).alias("terms"))
    found = durable(found.withColumn("_b", F.sha2(F.array_join("terms", " "), 256)))
    distinct = found.groupBy("_b").agg(F.sum(F.when(F.col("kind") == PARAGRAPH, F.col("n")).otherwise(0)).alias("n"), F.first("terms").alias("terms"))
    near = salted_join(found.select("_k", "kind", "share", "_b"), match_notices(distinct, templates, threshold), ["_b"], F.col("_k"), "inner")
    first = F.min(F.struct("kind", (-F.col("similarity")).alias("s"), "license", (-F.col("share")).alias("share")))
    return near.groupBy("_k").agg(first.alias("b")).select("_k", "b.license", (-F.col("b.s")).alias("similarity"), (-F.col("b.share")).alias("share"))


def scan(
    files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | Column = "path",
    licence_file: Column | None = None, threshold: float = 0.6, templates: DataFrame | None = None, share: float | None = None,
) -> DataFrame:
    """(doc_id, license, similarity, via, from_dir) of every file.

    via is ``own`` where a notice of the file itself matches a template, ``inherited`` where the nearest directory above
    (its own directory first) has a licence file that matches, else null. A licence file is one for which ``licence_file``
    holds; by default one named LICENSE, LICENCE, COPYING or NOTICE; with ``share`` also one of which the notice that matched
    takes at least that part. Of several in a directory the most similar counts,
    then the license whose name sorts first. Null and empty texts have no notice; a null path inherits nothing;
    repeated rows are judged each.
    """
    spark = files.sparkSession
    templates = template_table(spark) if templates is None else templates
    where = F.col(path) if isinstance(path, str) else path
    named = licence_file if licence_file is not None else F.element_at(F.split(where, "/"), -1).rlike(r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$")
    text = F.col(text_col).cast("string")
    rows = files.select(
        F.col(id_col).alias("doc_id"), F.regexp_replace(where, "/?[^/]*$", "").alias("dir"),
        F.when(_speaks(text), text).alias("text"), F.coalesce(named, F.lit(False)).alias("is_file"),
    )
    # rows without a notice get keys that match nothing and spread over the tasks
    rows = rows.withColumn("_k", F.coalesce(F.sha2("text", 256), F.hash("doc_id").cast("string")))
    distinct = rows.filter("text is not null").groupBy("_k").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    matched = salted_join(rows.drop("text"), match_texts(distinct, templates, threshold), ["_k"], F.col("doc_id")).drop("_k")
    if share is not None:
        matched = matched.withColumn("is_file", F.col("is_file") | F.coalesce(F.col("share") >= share, F.lit(False)))
    matched = durable(matched.drop("share"))
    owned = matched.filter("is_file and license is not null and dir is not null")
    of_dir = owned.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    of_dir = of_dir.select(F.col("dir").alias("up"), F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"))
    parts = F.split("dir", "/")
    above = matched.filter("license is null and dir is not null").select("dir").distinct().select(
        "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))).alias("a")
    ).select("dir", "a.depth", "a.up")
    nearest = salted_join(above, of_dir, ["up"], F.col("dir"), "inner").groupBy("dir").agg(
        F.max(F.struct("depth", "up", "license", "similarity")).alias("near")
    )
    out = salted_join(matched, nearest, ["dir"], F.col("doc_id"))
    own, near = F.col("license").isNotNull(), F.col("near").isNotNull()
    return out.select(
        "doc_id", F.coalesce("license", "near.license").alias("license"), F.coalesce("similarity", "near.similarity").alias("similarity"),
        F.when(own, "own").when(near, "inherited").alias("via"), F.when(~own, F.col("near.up")).alias("from_dir"),
    )
