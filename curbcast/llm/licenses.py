"""Licence scan: TF-IDF cosine to templates, and inheritance along directories.

Texts are cut into units at line ends and sentence ends.  A unit that holds a
licence word becomes a sparse TF-IDF vector over the templates' collection
(words outside it have the greatest weight) and is compared with every template
by a join on words; the best template from ``LEAST_COSINE`` on is its licence.
The words that decide between like licences may stand in another unit, so
blocks of a text are compared as a whole too: one to ``PARAGRAPHS``
paragraphs from the first one and from every one with a licence word, without
comment marks, against whole headers, whole short licences and the title
blocks of long licence files.  A block from
``LEAST_BLOCK`` on decides; otherwise a file's own licence is that of its best
unit.  The bodies of the long licences are not templates.

A file with a licence is a licence file if its name says so (``LICENSE``,
``COPYING.LESSER``) or if ``LEAST_SHARE`` of its letters lie in its notices,
wherever they stand: it also speaks for its directory.  Files without a notice
inherit from the nearest directory above them that has licence files, found by
joining every directory with its ancestors, so the join that touches files has
one row a directory.

Only DataFrame functions are used.  Defined results: null and empty texts have
no notice of their own; of equal cosines the first template name in order wins;
a directory with several licence files takes the licence most of them have,
then the first name; rows that repeat a path are one file; a null path is a
file at the root.
"""
from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pick
from .license_texts import BLOCKS

LEAST_COSINE = 0.6
LEAST_BLOCK = 0.75
PARAGRAPHS = 12                                   # of a block; a text has any number of blocks
TRIGGER = r"(?i)licen[cs]|copyright|permission|redistribut|warrant|public domain|all rights reserved"

# Notice texts of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "MIT": ["Released under the MIT License", "This project is licensed under the terms of the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
WORD = "[a-z]+|[0-9]+"


LEAST_SHARE = 0.8                                 # of a text's letters in its best block or in units with a licence word
FILE_NAME = r"(?i)(?:^|/)(?:(?:un)?licen[cs]es?|copying|copyright)(?:[-_][^/.]*(?:[0-9][.][0-9]+)?)?(?:[.](?:txt|md|rst|html?|lesser|lib|mit|bsd|apache|a?l?gpl))?$"
COMMENT = r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/|\*+|;+|--+|<!--|%+|dnl\b|REM\b)?[ \t]*"


def template_weights(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, word, unit-length weight) rows, inverse frequencies, and that of other words."""
    texts = [(name, Counter(re.findall(WORD, t.lower()))) for name in sorted(templates) for t in templates[name]]
    n, held = len(texts), Counter(w for _, c in texts for w in c)
    idf = {w: round(math.log((1 + n) / (1 + k)) + 1, 9) for w, k in held.items()}
    rows = []
    for number, (name, words) in enumerate(texts):
        length = math.sqrt(sum((k * idf[w]) ** 2 for w, k in words.items()))
        rows += [(number, name, w, round(k * idf[w] / length, 9)) for w, k in sorted(words.items())]
    return rows, idf, round(math.log(1 + n) + 1, 9)


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def _compared(units: DataFrame, templates: dict[str, list[str]], least: float) -> DataFrame:
    """(path, unit, license, cosine): the best template of every (path, unit, line) that reaches ``least``."""
    spark: SparkSession = units.sparkSession
    weights, idf, other = template_weights(templates)
    template = spark.createDataFrame(weights, "template int, license string, word string, weight double")
    frequency = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    # The templates are a fixed list, so both tables have a fixed size.
    words = units.distinct().select("path", "unit", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))).alias("word"))
    words = words.groupBy("path", "unit", "word").agg(F.count("*").alias("n")).join(F.broadcast(frequency), "word", "left")
    words = words.select("path", "unit", "word", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("value"))
    lengths = words.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    met = words.join(F.broadcast(template), "word").groupBy("path", "unit", "template", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scored = met.join(lengths, ["path", "unit"]).select("path", "unit", "license", F.round(F.col("dot") / F.col("length"), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = scored.groupBy("path", "unit", "license").agg(F.max("cosine").alias("cosine")).groupBy("path", "unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    return best.select("path", "unit", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"))


def _units(rows: DataFrame) -> DataFrame:
    """(path, unit, line) of the units that hold a licence word."""
    rows = rows.where(F.col("text").rlike(TRIGGER))
    return rows.select("path", F.posexplode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")).alias("unit", "line")).where(F.col("line").rlike(TRIGGER))


def notices(files: DataFrame, least: float = LEAST_COSINE, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, unit, license, cosine) of every unit that is a licence notice."""
    return _compared(_units(pick(files, path=path_col, text=text_col)), TEMPLATES, least)


def blocks(files: DataFrame, least: float = LEAST_BLOCK, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, license, cosine, letters) of the block, anywhere in the text, that is most like a whole header or licence.

    A block is a run of one to ``PARAGRAPHS`` paragraphs from the text's first one
    or from any that holds a licence word, as the first paragraph of every
    template does.
    """
    rows = pick(files, path=path_col, text=text_col).where(F.col("text").rlike(TRIGGER))
    plain = F.regexp_replace(F.regexp_replace("text", "\r", ""), COMMENT, "")
    parts = F.filter(F.split(plain, r"\n[ \t]*\n+"), lambda p: p.rlike("[A-Za-z0-9]"))
    rows = rows.select("path", parts.alias("parts")).where(F.size("parts") > 0)
    # Each row holds one start's paragraphs, so a text is not copied whole for every start.
    starts = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (i == 1) | F.element_at("parts", i).rlike(TRIGGER))
    runs = rows.select("path", F.explode(F.transform(starts, lambda i: F.slice("parts", i, F.lit(PARAGRAPHS)))).alias("run"))
    lines = F.transform(F.sequence(F.lit(1), F.size("run")), lambda n: F.array_join(F.slice("run", F.lit(1), n), "\n"))
    # Rows that repeat a path stay apart by their text.
    held = runs.select("path", F.explode(lines).alias("line")).where(F.col("line").rlike(TRIGGER)).distinct()
    held = held.withColumn("unit", F.xxhash64("line"))
    found = _compared(held, BLOCKS, least).join(held, ["path", "unit"])
    found = found.withColumn("letters", _letters(F.col("line")))
    best = found.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "letters")).alias("best"))
    return best.select("path", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"), F.col("best.letters").alias("letters"))


def directory(path: Column) -> Column:
    """The directory of a path; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, least: float = LEAST_COSINE, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, license, cosine, own, from_dir) of every file; license is null where nothing speaks for it."""
    rows = files.select(F.coalesce(path_col, F.lit("")).alias("path"), F.col(text_col).alias("text"))
    found = notices(rows, least).groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "unit", "license")).alias("best"))
    whole = blocks(rows).select("path", F.col("license").alias("block_license"), F.col("cosine").alias("block_cosine"), "letters")
    own = found.join(whole, "path", "full").select("path", F.coalesce("block_license", "best.license").alias("own_license"),
                                                   F.coalesce("block_cosine", -F.col("best.c")).alias("cosine"), F.coalesce("letters", F.lit(0)).alias("block_letters"))
    # Letters in units with a licence word, and in the text.
    noted = _units(rows).distinct().groupBy("path").agg(F.sum(_letters(F.col("line"))).alias("letters"))
    size = rows.where(F.col("text").rlike(TRIGGER)).distinct().groupBy("path").agg(F.sum(_letters(F.col("text"))).alias("size"))
    share = F.greatest("block_letters", F.coalesce("letters", F.lit(0))) / F.col("size")
    heads = own.join(noted, "path", "left").join(size, "path").where(F.col("path").rlike(FILE_NAME) | (share >= LEAST_SHARE))
    own = own.drop("block_letters")
    voices = heads.groupBy(directory(F.col("path")).alias("dir"), F.col("own_license").alias("license")).agg(F.count("*").alias("n"))
    speaking = voices.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("v")).select(F.col("dir").alias("from_dir"), F.col("v.license").alias("dir_license"))
    dirs = rows.select(directory(F.col("path")).alias("dir")).distinct()
    # Every directory with itself and its ancestors; depth counts the parts they keep.
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ancestors = dirs.select("dir", parts.alias("parts")).select("dir", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    ancestors = ancestors.select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("from_dir"))
    nearest = ancestors.join(speaking, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license")).alias("v"))
    nearest = nearest.select("dir", "v.from_dir", "v.dir_license")
    every = rows.select("path").distinct().withColumn("dir", directory(F.col("path"))).join(own, "path", "left").join(nearest, "dir", "left")
    return every.select("path", F.coalesce("own_license", "dir_license").alias("license"), "cosine", F.col("own_license").isNotNull().alias("own"),
                        F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"))
