"""Licence scans.

Texts are cut into lines and sentences; those that speak of licences at all
are compared with the lines of licence templates by sparse TF-IDF cosine:
words are joined with the templates' posting lists and weights are summed a
(line, template line) pair.  A text declares the licence with the highest sum
of matched weights.

A file is a licence file if it is named like one or is mostly licence text.
Its licence holds for its folder, and files without a declaration take that
of their nearest ancestor folder: distinct folders are expanded to their
ancestors and joined with the licence folders by path.

DataFrame and SQL functions only.  Null and empty texts declare nothing, but
inherit; a null path has no folder.  Repeated rows are resolved row by row.
Equal scores go to the licence that sorts first.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Licence identifiers and the lines that declare them (fixed values).
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
                 "of the License, or any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
                   "or implied."],
    "BSD-3-Clause": ["Released under the BSD License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions of this license are met.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 2 of the License, "
                "or any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or any later version."],
    "ISC": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License, Version 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: A line without any of these is no licence line; every template line has one.
CUE = r"licen[sc]e|copyright|redistribut|public domain|permission|warrant"

_WORD = r"[a-z0-9]+(?:[.][0-9]+)*"
_LINE = r"\n|(?<=[.!?;])\s+(?=[^a-z0-9])"
_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([-._][^/]*)?$"


def template_lines(templates: dict[str, list[str]]) -> list[tuple[str, int, dict[str, int]]]:
    """(licence, line number, word counts); refuses lines without a cue."""
    out = []
    for name, lines in sorted(templates.items()):
        for i, line in enumerate(lines):
            if not re.search(CUE, line.lower()):
                raise ValueError(f"template line without a licence word: {line}")
            out.append((name, i, Counter(re.findall(_WORD, line.lower()))))
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def vocabulary(df: DataFrame, text: str, terms: list[str]) -> dict[str, float]:
    """Inverse document frequency of the template words over all texts."""
    mine = F.array_intersect(words(F.col(text)), F.array(*[F.lit(w) for w in terms]))
    got = (df.select(F.explode(F.when(F.lower(F.col(text)).rlike("[a-z0-9]"), mine)).alias("w")).groupBy("w").count()
           .collect())  # one row a template word at most
    n = df.count()
    seen = {r["w"]: r["count"] for r in got}
    return {w: 1 + math.log((n + 1) / (seen.get(w, 0) + 1)) for w in terms}


def declared(corpus: DataFrame, df: DataFrame, similar: float, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(row, license, cosine, share): the declared licence of each row of
    ``df`` (row, t) that has one, its best line cosine, and the part of the
    text that its lines make up.  ``corpus`` (t) gives the word frequencies."""
    spark: SparkSession = df.sparkSession
    lines = template_lines(templates or TEMPLATES)
    terms = sorted({w for _, _, c in lines for w in c})
    idf = vocabulary(corpus, "t", terms)
    top = max(idf.values())
    postings = []
    for t, (name, _, counts) in enumerate(lines):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        postings += [(w, t, name, n * idf[w] / norm) for w, n in counts.items()]
    posting = spark.createDataFrame(postings, "w string, t int, license string, weight double")
    weight = spark.createDataFrame(list(idf.items()), "w string, idf double")
    said = (df.filter(F.lower("t").rlike(CUE))
            .select("row", F.char_length("t").alias("chars"), F.posexplode(F.split("t", _LINE)))
            .filter(F.lower("col").rlike(CUE))
            .select("row", "chars", F.col("pos").alias("line"), F.char_length("col").alias("size"), words(F.col("col")).alias("ws")))
    said = stored(said, "licence-lines")
    counts = said.select("row", "line", F.explode("ws").alias("w")).groupBy("row", "line", "w").agg(F.count("*").alias("n"))
    weighted = (counts.join(F.broadcast(weight), "w", "left")  # one row a template word
                .withColumn("x", F.col("n") * F.coalesce("idf", F.lit(top))))  # unknown words count as the rarest
    norms = weighted.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = (weighted.join(F.broadcast(posting), "w")  # one row a template word and line
            .groupBy("row", "line", "t", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot")))
    near = (dots.join(norms, ["row", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
            .filter(F.col("cosine") >= similar).groupBy("row", "line", "license").agg(F.max("cosine").alias("cosine"), F.max("norm").alias("norm")))
    sizes = said.select("row", "line", "size", "chars")
    each = (near.join(sizes, ["row", "line"]).groupBy("row", "license")
            .agg(F.round(F.sum(F.col("cosine") * F.col("norm")), 6).alias("sum"), F.max("cosine").alias("cosine"),
                 F.least(F.sum("size") / F.max("chars"), F.lit(1.0)).alias("share")))
    return (each.groupBy("row").agg(F.min(F.struct((-F.col("sum")).alias("order"), "license", "cosine", "share")).alias("best"))
            .select("row", "best.license", "best.cosine", "best.share"))


def folder(path: Column) -> Column:
    """The path without its last step; '' at the top; null for null."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """array of (depth, folder): the folder itself and all above it."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.when(path == "", 0).otherwise(F.size(steps))),
                       lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")))


def resolve(df: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", similar: float = 0.7,
            mostly: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each input row: key, path, license (null: none), origin
    (`declared`, `inherited` or `none`), cosine, license_folder.

    ``mostly``: share of a text's characters in licence lines from which the
    file counts as a licence file whatever its name.
    """
    rows = df.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("t"))
    slim = stored(rows.select("key", "path", F.when(F.lower("t").rlike(CUE), F.col("t")).alias("t"))
                  .withColumn("row", F.monotonically_increasing_id()), "licence-rows")
    # inverse frequencies need all texts, lines only those with a licence word
    own = declared(rows.select(text_or_empty("t").alias("t")), slim, similar, templates)
    named = stored(slim.select("row", "key", "path", folder(F.col("path")).alias("folder")).join(own, "row", "left"), "licence-own")
    files = named.filter(F.col("license").isNotNull() & F.col("path").isNotNull()
                         & (F.col("path").rlike(_FILE) | (F.col("share") >= mostly)))
    best = F.min(F.struct((-F.col("cosine")).alias("order"), F.col("license").alias("lic"))).alias("best")
    homes = files.groupBy(F.col("folder").alias("up")).agg(best).select("up", F.col("best.lic").alias("given"))
    asked = named.filter("license is null and folder is not null").select("folder").distinct()
    nearest = (asked.select("folder", F.inline(ancestors(F.col("folder")))).join(homes, "up").groupBy("folder")
               .agg(F.max(F.struct("depth", "up", "given")).alias("near")).select("folder", "near.up", "near.given"))
    return (named.join(nearest, "folder", "left")
            .select(F.col("key").alias(key), F.col("path").alias(path), F.coalesce("license", "given").alias("license"),
                    F.when(F.col("license").isNotNull(), "declared").when(F.col("given").isNotNull(), "inherited")
                    .otherwise("none").alias("origin"), "cosine",
                    F.when(F.col("license").isNull(), F.col("up")).alias("license_folder")))
