"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A document's header is its lines that speak of a licence. Each sentence and line of it, and each paragraph that is to a
good part header, is compared by itself with statements, and the whole text with full licence texts where it has their
signs; copyright lines are left out. In short parts unknown words have no weight, but the licence must be named, and a
version must agree. An SPDX tag counts as it stands, expressions included. Parts and templates become sparse vectors of
words, weighted by count and inverse frequency among the templates; the dot products come from a join of header words with
the words of the templates (a table of fixed size, broadcast), and only documents that have a header are exploded: these are
written once. A document whose text is mostly header, is a full licence text, or has the name of a licence file is one: its
licence holds for its directory. Each directory takes the licence of its nearest ancestor that has one, itself included, by
an equi-join of its ancestors' paths; documents without a licence of their own take that of their directory. Everything is
DataFrame functions; texts are never shuffled.

Defined results: null and empty texts have no header. Without a match of at least ``MIN_COSINE`` and without an ancestor's
licence, ``licence`` is null and ``origin`` is ``none``. If a directory has several licence files, the highest cosine
counts, then the first licence by name. A null path has no directory and inherits nothing. Documents are told apart by id
and path; repeated rows share one result. Extra columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.llm.common import Workspace, table

#: Statements by which licences are declared, under their SPDX names; further statements of one licence after a ``#``.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#file": "You may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause#terms": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0#name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0#name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT#terms": "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy.",
    "Apache-2.0#title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0#name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "GPL-2.0#notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0#notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "ISC": "Licensed under the ISC License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
HEADER = r"(?i)licen[sc]e|copyright|spdx-|permission is hereby granted"
TOKEN = r"[^a-z0-9.\-]+"
MIN_COSINE = 0.6
#: A whole text must come so near to a full licence text.
MIN_FULL = 0.8
#: Parts of at most this many words give unknown words no weight, but must name the licence.
SHORT = 40
NAMES = {"Apache": ["apache"], "BSD": ["bsd", "redistribution"], "CC": ["cc", "commons"], "AGPL": ["affero", "agpl"], "GPL": ["gnu", "gpl"], "LGPL": ["lesser", "lgpl"], "ISC": ["isc"], "MIT": ["mit", "hereby"], "MPL": ["mozilla", "mpl"]}
VERSION = r"^v?[0-9](\.[0-9]+)*$"
FULL_SIGN = r"(?i)permission is hereby granted|is hereby granted, provided|redistribution and use in source|terms and conditions|public license|cc0 1\.0|lesser general"
#: One of these is in every text that HEADER or FULL_SIGN finds; looking for them first spares most texts the patterns.
SIGNS = ("licen", "copyright", "spdx-", "hereby granted", "redistribution and use", "terms and conditions", "cc0 1.0", "lesser general")
FILE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying)[^/]*$"
SPDX = r"(?i:SPDX-License-Identifier):[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+\-]*\)*(?:[ ]+(?:OR|AND|WITH)[ ]+\(*[A-Za-z0-9][A-Za-z0-9.+\-]*\)*)*)"
COPYRIGHT_LINE = r"(?im)^[^a-z0-9\n]*(?:copyright\b|\(c\)|©)(?![^\n]*licen[sc]e)[^\n]*$|^[^a-z0-9\n]*all rights reserved[.]?[ \t]*$"
#: A licence file is header for at least this share of its characters; a paragraph that is compared whole, for this one.
FILE_SHARE = 0.5
PARAGRAPH_SHARE = 0.25


def _words(text: str) -> list[str]:
    return [w.strip(".-") for w in re.split(TOKEN, text.lower()) if w.strip(".-")]


def template_weights(templates: dict[str, str]) -> tuple[dict[str, float], list[tuple[str, str, float]], float]:
    """Inverse frequencies, ``(word, licence, weight / norm)`` of each template, and the weight of unknown words."""
    counts = {name: Counter(_words(text)) for name, text in templates.items()}
    spread = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in spread.items()}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        rows += [(w, name, n * idf[w] / norm) for w, n in c.items()]
    return idf, rows, math.log(1 + len(templates)) + 1


@lru_cache
def full_texts() -> dict[str, str]:
    """The licence texts of the folder ``licences``, without copyright lines."""
    found = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files("grainframe.llm").joinpath("licences").iterdir() if f.name.endswith(".txt")}
    return {name: re.sub(COPYRIGHT_LINE, "", text) for name, text in sorted(found.items())}


def words_in(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), TOKEN), lambda w: F.btrim(w, F.lit(".-"))), lambda w: w != "")


def nearest_template(parts: DataFrame, templates: dict[str, str], short: int = 0) -> DataFrame:
    """``doc_id, path, licence, cosine`` of the best pair of a document's parts (doc_id, path, part) and a template.

    In parts of at most ``short`` words, words that no template has count only as versions, and a licence of ``NAMES`` must be named.
    """
    idf, rows, unknown = template_weights(templates)
    words = parts.sparkSession.createDataFrame([(w, n, weight, idf[w]) for w, n, weight in rows], "word string, licence string, weight double, idf double")
    by_word = F.broadcast(words.groupBy("word").agg(F.first("idf").alias("idf"), F.map_from_entries(F.collect_list(F.struct("licence", "weight"))).alias("weights")))
    signs = [(n, NAMES.get(n.split("-")[0], []), [w for w in dict.fromkeys(_words(t)) if re.search(VERSION, w)]) for n, t in templates.items()]
    named = F.broadcast(parts.sparkSession.createDataFrame(signs, "licence string, names array<string>, versions array<string>"))
    key = ["doc_id", "path", "id"]
    split = parts.select("doc_id", "path", words_in(F.col("part")).alias("words")).withColumn("id", F.xxhash64("words")).dropDuplicates(key)
    split = split.withColumn("brief", F.size("words") <= short).withColumn("said", F.when(F.col("brief"), F.array_distinct("words")))
    counted = split.select(*key, "brief", "said", F.explode("words").alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"), F.first("brief").alias("brief"), F.first("said").alias("said"))
    left_out = F.col("brief") & ~F.col("word").rlike("[0-9]")
    weighed = counted.join(by_word, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.when(left_out, 0.0).otherwise(unknown)))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.first("brief").alias("brief"), F.first("said").alias("said"), F.collect_list(F.when(F.col("weights").isNotNull(), F.struct("w", "weights"))).alias("known"))
    products = norms.select(*key, "norm", "brief", "said", F.explode("known").alias("k")).select(*key, "norm", "brief", "said", "k.w", F.explode("k.weights").alias("licence", "weight"))
    cosines = products.groupBy(*key, "licence").agg((F.sum(F.col("w") * F.col("weight")) / F.first("norm")).alias("cosine"), F.first("brief").alias("brief"), F.first("said").alias("said"))
    said_versions = F.filter("said", lambda w: w.rlike(VERSION))
    agrees = (F.size("versions") == 0) | (F.size(said_versions) == 0) | F.arrays_overlap("versions", said_versions)
    fits = ~F.col("brief") | (((F.size("names") == 0) | F.arrays_overlap("names", "said")) & agrees)
    cosines = cosines.join(named, "licence").where(fits).withColumn("cosine", F.round("cosine", 9)).withColumn("licence", F.split_part("licence", F.lit("#"), F.lit(1)))
    return cosines.groupBy("doc_id", "path").agg(F.max("cosine").alias("cosine"), F.min_by("licence", F.struct(-F.col("cosine"), F.col("licence"))).alias("licence"))


def headed_texts(docs: DataFrame) -> DataFrame:
    """The documents with a header or the signs of a full text, and ``bare``: the text without copyright lines."""
    low = F.lower("text")
    signed = reduce(Column.__or__, (low.contains(sign) for sign in SIGNS))
    found = docs.where(signed).where(F.col("text").rlike(HEADER) | F.col("text").rlike(FULL_SIGN))
    return found.withColumn("bare", F.regexp_replace("text", COPYRIGHT_LINE, ""))


def own_licences(headed: DataFrame, templates: dict[str, str] | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``doc_id, path, licence, cosine, is_file`` of those of the ``headed_texts`` that declare a licence.

    An SPDX tag comes first, then a full text, then the best statement.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADER))
    bare_lines = F.filter(F.split("bare", "\n"), lambda x: x.rlike(HEADER))
    sentences = F.flatten(F.transform(bare_lines, lambda x: F.split(x, r"(?<=[A-Za-z0-9)\"'][.;:])\s+(?=[A-Z(])")))
    told = lambda x: F.length(F.array_join(F.filter(F.split(x, "\n"), lambda line: line.rlike(HEADER)), "\n"))
    paragraphs = F.filter(F.split("bare", r"\n(?:[^A-Za-z0-9\n]*\n)+"), lambda x: x.rlike(HEADER) & (told(x) >= PARAGRAPH_SHARE * F.length(x)))
    parts = headed.select("doc_id", "path", F.explode(F.array_distinct(F.concat(bare_lines, F.filter(sentences, lambda x: x.rlike(HEADER)), paragraphs))).alias("part"))
    stated = nearest_template(parts, templates or TEMPLATES, SHORT).where(F.col("cosine") >= min_cosine)
    whole = headed.where(F.col("text").rlike(FULL_SIGN)).select("doc_id", "path", F.col("bare").alias("part"))
    full = nearest_template(whole, full_texts()).where(F.col("cosine") >= MIN_FULL)
    tagged = headed.select("doc_id", "path", F.regexp_extract("text", SPDX, 1).alias("licence")).where("licence <> ''").select("doc_id", "path", F.lit(1.0).alias("cosine"), "licence")
    found = [t.withColumn("rank", F.lit(i)) for i, t in enumerate((tagged, full, stated))]
    found = found[0].unionByName(found[1]).unionByName(found[2])
    best = found.groupBy("doc_id", "path").agg(F.min_by(F.struct("licence", "cosine"), F.struct("rank", "licence")).alias("b"), F.min(F.when(F.col("rank") == 1, 0)).alias("full"))
    is_file = (F.length(F.array_join(lines, "\n")) >= FILE_SHARE * F.length("text")) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    shares = headed.select(F.col("doc_id").alias("i"), F.col("path").alias("p"), is_file.alias("is_file")).groupBy("i", "p").agg(F.max("is_file").alias("is_file"))
    joined = best.join(shares, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")))
    return joined.select("doc_id", "path", "b.licence", "b.cosine", (F.col("is_file") | F.col("full").isNotNull()).alias("is_file"))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """``dir, licence, from_dir`` of each of the ``directories`` (dir) with a licensed ancestor; ``licensed``: dir, licence."""
    parts = F.split("dir", "/")
    above = directories.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("from_dir"))
    found = above.join(licensed.withColumnRenamed("dir", "from_dir"), "from_dir")
    return found.groupBy("dir").agg(F.max_by("licence", F.length("from_dir")).alias("licence"), F.max_by("from_dir", F.length("from_dir")).alias("from_dir"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``doc_id, path, licence, cosine, origin, from_dir`` of every row of ``docs`` (doc_id, path, text).

    ``origin`` is ``header``, ``file``, ``inherited`` or ``none``.
    """
    work = Workspace(docs.sparkSession, "licences")
    headed = work.save(headed_texts(docs.select("doc_id", "path", "text")), "headed")
    own = work.save(own_licences(headed, templates, min_cosine), "own")
    work.drop("headed")
    files = own.where("is_file AND path IS NOT NULL").withColumn("dir", directory_of(F.col("path")))
    licensed = files.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("cosine"), F.col("licence"))).alias("licence"))
    rows = docs.select("doc_id", "path").withColumn("dir", directory_of(F.col("path")))
    from_above = inherited(rows.where("dir IS NOT NULL").select("dir").distinct(), licensed).select("dir", F.col("licence").alias("dir_licence"), "from_dir")
    mine = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), F.col("licence").alias("own_licence"), "cosine", "is_file")
    joined = rows.join(mine, rows["doc_id"].eqNullSafe(mine["own_id"]) & rows["path"].eqNullSafe(mine["own_path"]), "left").join(from_above, "dir", "left")
    is_own = F.col("own_licence").isNotNull()
    origin = F.when(is_own & F.col("is_file"), "file").when(is_own, "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("own_licence", "dir_licence").alias("licence"), "cosine", origin.alias("origin"), F.when(~is_own, F.col("from_dir")).alias("from_dir"))


def path_of() -> Column:
    """A path for the documents table, which has none: source, language and a folder of 64 ids."""
    folder = F.floor(F.col("doc_id") / 64).cast("string")
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op8(spark, sf_dir: str) -> DataFrame:
    """``op8_license_scan``: the licence of every document, its own or inherited."""
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", path_of().alias("path"), "text"))
