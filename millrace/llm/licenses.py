"""Operator 1: licence scans with DataFrame operations only.

Files are (doc_id, path, text). Units of comparison are the lines of a file that hold a licence cue, the WINDOWS of
adjacent lines around each of them (headers wrap) and, of a file named like a licence file, its whole text too. Units
repeat, so each distinct unit is compared once: its terms are weighted by tf-idf (idf over the templates; a term that no
template has gets the largest idf) and the cosine to every template is a sparse join on the term. A file's own licence is
its best unit's best template with a cosine of at least MIN_COSINE; ties go to the greater cosine, then to the first
template name. An SPDX identifier that names a licence of the templates is taken as it stands, with cosine 1; of an
expression the first identifier counts. The idf is that of TEMPLATES, without HEADERS.

A file without one inherits from the nearest ancestor directory that has a licence file with a match: each distinct
directory is joined with its ancestors by path, and the deepest one wins. If a directory has several such files, the
best cosine counts, then the first template name, then the first path.

Result: one row a file, origin `own`, `inherited` or `none`. Null paths count as the empty path in the root directory,
null texts as empty. Repeated rows are judged row by row. Texts are read once: what the later joins need, the units of
files with a cue and a hash of each, is written below the checkpoint folder. The templates, a fixed table, are broadcast,
and the answers for headers or directories that more than one part in 1,024 of all files share; the files of those, and
files without a unit, lie spread over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.components import look_up

MIN_COSINE = 0.5
#: Short notices by which files name their licence, several forms a licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
]
#: Further forms, which stand in files as wrapped headers.
HEADERS = [
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License."),
]
#: Units around a cue line: lines before it and lines behind it.
WINDOWS = ((0, 0), (0, 1), (1, 0), (1, 1), (0, 3), (2, 1))
SPDX, SPDX_END = "(?i)SPDX-License-Identifier:[ \\t(]*([A-Za-z0-9.-]+)", "(?i)(-only|-or-later)?[.-]*$"
#: Lower-case cues that a line must hold one of.
CUES = ("licen", "copyright", "all rights reserved", "spdx", "permission is hereby", "permission to use", "redistribution and use", "waived all")
TERM = "([a-z0-9]+(?:[.][0-9]+)*)"
LICENCE_FILE = "^(license|licence|copying|notice|unlicense)([._-].*)?$"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


_FORMS = [(k, name, text) for k, (name, text) in enumerate(TEMPLATES)]


def templates(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """((form, licence, term, weight), (term, idf)): unit-length tf-idf vectors of the templates, and the idf."""
    every = _FORMS + [(len(_FORMS) + k, name, text) for k, (name, text) in enumerate(HEADERS)]
    forms = spark.sql(f"SELECT * FROM VALUES {_values(every)} AS t(form, licence, text)")
    terms = forms.select("form", "licence", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(1))).alias("term")).groupBy("form", "licence", "term").agg(F.count("*").alias("tf"))
    idf = terms.where(F.col("form") < len(TEMPLATES)).groupBy("term").agg((F.log((1.0 + len(TEMPLATES)) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    most = F.lit(1.0) + F.log(F.lit(1.0 + len(TEMPLATES)))
    weighted = terms.join(idf, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", most))
    norms = weighted.groupBy("form").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norms, "form").select("form", "licence", "term", (F.col("weight") / F.col("norm")).alias("weight")), idf


def _cued(line: Column) -> Column:
    low, found = F.lower(line), F.lit(False)
    for cue in CUES:
        found = found | low.contains(cue)
    return found


def _windows(lines: Column) -> Column:
    """The cue lines of an array of lines, and the lines around each of them."""
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda k: _cued(F.element_at(lines, k)))
    around = lambda k, a, b: F.array_join(F.slice(lines, F.greatest(k - a, F.lit(1)), k + b + 1 - F.greatest(k - a, F.lit(1))), "\n")
    return F.flatten(F.transform(at, lambda k: F.array(*[around(k, a, b) for a, b in WINDOWS])))


def declared(text: Column) -> Column:
    """The licence that the text's first SPDX identifier names, null if no template has it."""
    found, out = F.lower(F.regexp_replace(F.regexp_extract(text, SPDX, 1), SPDX_END, "")), F.lit(None).cast("string")
    for name in sorted({name for name, _ in TEMPLATES} - {"Proprietary"}):
        out = F.when(found == name.lower(), F.lit(name)).otherwise(out)
    return out


def score_units(units: DataFrame) -> DataFrame:
    """units(unit) -> (hash, licence, cosine): the best template of each distinct unit that shares a term with one."""
    spark = units.sparkSession
    vectors, idf = templates(spark)
    most = F.lit(1.0) + F.log(F.lit(1.0 + len(TEMPLATES)))
    distinct = units.select("hash", "unit").dropDuplicates(["hash"])
    counted = distinct.select("hash", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(1))).alias("term")).groupBy("hash", "term").agg(F.count("*").alias("tf"))
    weighted = counted.join(F.broadcast(idf), "term", "left").select("hash", "term", (F.col("tf") * F.coalesce("idf", most)).alias("w"))
    norms = weighted.groupBy("hash").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighted.join(F.broadcast(vectors), "term").groupBy("hash", "form", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("length"), 9)
    best = dots.join(norms, "hash").groupBy("hash").agg(F.min(F.struct((-cosine).alias("c"), "licence")).alias("b"))
    return best.select("hash", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    """Everything before the last slash; a path without one lies in the root directory, the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, path, text) -> (doc_id, path, licence, cosine, origin, licence_dir), one row a file."""
    rows = files.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("path"), F.lit("")).alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    named = F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike(LICENCE_FILE)
    whole = F.when(named, F.array("text")).otherwise(F.array().cast("array<string>"))
    found = F.when(_cued(F.col("text")) | named, F.concat(_windows(F.split("text", "\n")), whole)).otherwise(F.array().cast("array<string>"))
    looked = rows.select("doc_id", "path", named.alias("is_licence"), declared(F.col("text")).alias("declared"), F.array_distinct(found).alias("units"))
    hashed = F.transform("units", lambda u: F.struct(F.sha2(u, 256).alias("hash"), u.alias("unit")))
    looked = written(looked.select("doc_id", "path", "is_licence", "declared", hashed.alias("units")))
    total = looked.count()
    scored = written(score_units(looked.select(F.explode("units").alias("u")).select("u.hash", "u.unit")).where(F.col("cosine") >= min_cosine))

    # per distinct set of unit hashes, the best unit; files of equal units share the answer
    slim = looked.select("doc_id", "path", directory(F.col("path")).alias("dir"), "is_licence", "declared", F.array_sort(F.transform("units", lambda u: u["hash"])).alias("hashes")).withColumn("key", F.when(F.size("hashes") > 0, F.sha2(F.concat_ws(",", "hashes"), 256)))
    sets = slim.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("hashes").alias("hashes"), F.count("*").alias("n"))
    member = sets.select("key", F.col("n").alias("files"), F.explode("hashes").alias("hash"))
    answers = scored.join(member.groupBy("hash").agg(F.count("*").alias("n")), "hash")
    rated = look_up(member, answers, "hash", member.count())  # one line may stand in most sets
    best = rated.groupBy("key", F.col("files").alias("n")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    best = best.select("key", "n", F.col("b.licence").alias("best"), (-F.col("b.c")).alias("best_cosine"))
    owned = look_up(slim.drop("hashes"), best, "key", total, every=True)
    owned = written(owned.select("doc_id", "path", "is_licence", "dir", F.coalesce("declared", "best").alias("own"), F.when(F.col("declared").isNotNull(), 1.0).otherwise(F.col("best_cosine")).alias("own_cosine")))

    given = owned.where(F.col("is_licence") & F.col("own").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("own").alias("licence"), "path")).alias("b"))
    given = given.select(F.col("dir").alias("ancestor"), F.col("b.licence").alias("from_licence"), (-F.col("b.c")).alias("from_cosine"))
    parts = F.split("dir", "/")
    dirs = owned.groupBy("dir").agg(F.count("*").alias("files"))
    above = dirs.select("dir", "files", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))).alias("ancestor"))
    below = above.groupBy("ancestor").agg(F.count("*").alias("n"))
    nearest = look_up(above, given.join(below, "ancestor"), "ancestor", dirs.count())
    nearest = nearest.groupBy("dir", F.col("files").alias("n")).agg(F.max_by(F.struct(F.col("ancestor").alias("holder"), "from_licence", "from_cosine"), F.length("ancestor")).alias("h")).select("dir", "n", "h.holder", "h.from_licence", "h.from_cosine")
    out = look_up(owned, nearest, "dir", total, every=True)
    mine, theirs = F.col("own").isNotNull(), F.col("from_licence").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own", "from_licence").alias("licence"), F.round(F.coalesce("own_cosine", "from_cosine"), 6).alias("cosine"),
        F.when(mine, "own").when(theirs, "inherited").otherwise("none").alias("origin"), F.when(~mine & theirs, F.col("holder")).alias("licence_dir"),
    )


#: The tree of as_files: ids in one directory at each depth below the source, and how often a file is a licence file.
DEPTHS, EVERY = (10_000, 1_000, 200), 10


def as_files(docs: DataFrame) -> DataFrame:
    """The documents as a source tree, source / ten thousands / thousands / two hundreds / file. Every tenth file is a
    licence file, LICENSE-id; they lie in turn in the source's directory, below it, and so on down to the deepest one, so
    that licences of several depths compete and files inherit from far above."""
    source, deep = F.coalesce(F.col("source").cast("string"), F.lit("none")), len(DEPTHS)
    parts = F.array(source, *[F.floor(F.col("doc_id") / n).cast("string") for n in DEPTHS])
    is_licence = F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False))
    kept = F.when(is_licence, F.pmod(F.floor(F.col("doc_id") / EVERY), F.lit(deep + 1)).cast("int") + 1).otherwise(deep + 1)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    name = F.when(is_licence, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", F.slice(parts, F.lit(1), kept), name).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_CUE_SQL = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{cue}')" for cue in CUES) + ")"
_EVERY_FORM = _FORMS + [(len(_FORMS) + k, name, text) for k, (name, text) in enumerate(HEADERS)]
_MOST_SQL = f"1.0 + ln({1.0 + len(TEMPLATES)})"
_DIR_SQL = "array_to_string(list_slice([coalesce(source, 'none'), " + ", ".join(f"CAST(doc_id // {n} AS VARCHAR)" for n in DEPTHS) + f"], 1, CASE WHEN doc_id % {EVERY} = 0 THEN (doc_id // {EVERY}) % {len(DEPTHS) + 1} + 1 ELSE {len(DEPTHS) + 1} END), '/')"
_NAMED_SQL = ", ".join(f"('{name}')" for name in sorted({name for name, _ in TEMPLATES} - {"Proprietary"}))
_SLICES_SQL = ", ".join(f"array_to_string(list_slice(lines, greatest(k - {a}, 1), k + {b}), chr(10))" for a, b in WINDOWS)
ORACLE_SQL = f"""
WITH forms AS (SELECT * FROM (VALUES {_values(_EVERY_FORM)}) AS t(form, licence, text)),
tterm AS (SELECT form, licence, unnest(regexp_extract_all(lower(text), '{TERM}', 1)) AS term FROM forms),
ttf AS (SELECT form, licence, term, count(*) AS tf FROM tterm GROUP BY ALL),
idf AS (SELECT term, ln({1.0 + len(TEMPLATES)} / (1.0 + count(*))) + 1.0 AS idf FROM ttf WHERE form < {len(TEMPLATES)} GROUP BY term),
tw AS (SELECT form, licence, ttf.term, tf * coalesce(idf, {_MOST_SQL}) AS w FROM ttf LEFT JOIN idf USING (term)),
tn AS (SELECT form, sqrt(sum(w * w)) AS norm FROM tw GROUP BY form),
tv AS (SELECT form, licence, term, w / norm AS weight FROM tw JOIN tn USING (form)),
files AS (SELECT doc_id, coalesce(text, '') AS text, {_DIR_SQL} AS dir, doc_id % {EVERY} = 0 AS is_licence FROM documents),
split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM files),
cued AS (SELECT doc_id, lines, k FROM split, unnest(generate_series(1, len(lines))) AS t(k) WHERE {_CUE_SQL('lines[k]')}),
units AS (SELECT DISTINCT doc_id, unnest([{_SLICES_SQL}]) AS unit FROM cued UNION SELECT doc_id, text FROM files WHERE is_licence),
du AS (SELECT DISTINCT unit FROM units),
uterm AS (SELECT unit, unnest(regexp_extract_all(lower(unit), '{TERM}', 1)) AS term FROM du),
utf AS (SELECT unit, term, count(*) AS tf FROM uterm GROUP BY ALL),
uw AS (SELECT unit, utf.term, tf * coalesce(idf, {_MOST_SQL}) AS w FROM utf LEFT JOIN idf USING (term)),
un AS (SELECT unit, sqrt(sum(w * w)) AS len FROM uw GROUP BY unit),
dots AS (SELECT unit, form, licence, sum(w * weight) AS dot FROM uw JOIN tv USING (term) GROUP BY ALL),
cosines AS (SELECT unit, licence, round(dot / len, 9) AS c FROM dots JOIN un USING (unit)),
bests AS (SELECT doc_id, arg_min(licence, (-c, licence)) AS best, max(c) AS best_cosine FROM units JOIN cosines USING (unit) WHERE c >= {MIN_COSINE} GROUP BY doc_id),
said AS (SELECT doc_id, name AS declared FROM files JOIN (VALUES {_NAMED_SQL}) AS v(name) ON lower(name) = lower(regexp_replace(regexp_extract(text, '{SPDX}', 1), '{SPDX_END}', ''))),
owned AS (SELECT f.doc_id, f.dir, f.dir || '/' || CASE WHEN is_licence THEN 'LICENSE-' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '.txt' END AS path, is_licence, coalesce(declared, best) AS own, CASE WHEN declared IS NOT NULL THEN 1.0 ELSE best_cosine END AS own_cosine FROM files f LEFT JOIN bests USING (doc_id) LEFT JOIN said USING (doc_id)),
given AS (SELECT dir AS holder, arg_min(own, (-own_cosine, own, path)) AS l, max(own_cosine) AS c FROM owned WHERE is_licence AND own IS NOT NULL GROUP BY dir),
near AS (SELECT dir, max_by(holder, length(holder)) AS holder FROM (SELECT DISTINCT dir FROM owned) JOIN given ON holder = '' OR dir = holder OR starts_with(dir, holder || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(own, l) AS licence, round(coalesce(own_cosine, c), 6) AS cosine,
 CASE WHEN own IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
 CASE WHEN own IS NULL AND l IS NOT NULL THEN near.holder END AS licence_dir
FROM owned LEFT JOIN near USING (dir) LEFT JOIN given ON given.holder = near.holder
"""
