"""Licences of files: TF-IDF cosine to templates, and inheritance from the nearest directory.

A text is cut into statements (lines, and sentences of a line), so a header counts wherever it stands. Statements and templates are
vectors of term counts times idf, ln(1 + N / (1 + df)), with df counted over all documents for the
templates' terms; a term that no template has gets the idf of df 0, so foreign words lower the
cosine. Templates are notices that name a licence and sentences of licences, each with the words that tell it
from others (Apache, 2, 0): a statement without one of these is no match, however alike the rest is. The best
template of a file's statements, if its cosine is at least `least`, is the file's own licence. For a licence file (named LICENSE, COPYING, NOTICE or so) it is also the licence of
its directory, and a file without own licence takes that of its nearest ancestor directory that
has one, by an equality join of directories and their ancestors.

Only statements that hold one of the key terms are scored. Key terms are chosen so that a statement
without any can't reach `least`: per template, the heaviest terms are taken until the rest of its
squared weight is below least squared of the whole, which bounds the cosine (Cauchy-Schwarz).

All is built-in functions. Broadcast are only tables of the templates' terms, whose size hangs on
the templates. Directories are resolved once each, not once per file.

Edge cases: null or blank text has no own licence; a null path is in no directory; rows with equal
path and statements are scored once and all returned; of equal cosines the first template by name
counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: SPDX identifiers, the names that licences go by, and the words that tell a name from others.
NAMES = {
    "0BSD": ("BSD Zero Clause License", "bsd zero clause"),
    "AFL-3.0": ("Academic Free License, version 3.0", "academic free 3 0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "gnu affero 3"),
    "Apache-1.1": ("Apache License, Version 1.1", "apache 1 1"),
    "Apache-2.0": ("Apache License, Version 2.0", "apache 2 0"),
    "Artistic-2.0": ("Artistic License 2.0", "artistic 2 0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "bsd 2 clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "bsd 3 clause"),
    "BSD-4-Clause": ("BSD 4-Clause License", "bsd 4 clause"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "boost 1 0"),
    "CC-BY-3.0": ("CC BY 3.0", "cc by 3 0"),
    "CC-BY-4.0": ("CC BY 4.0", "cc by 4 0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "cc by nc 4 0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "cc by nc nd 4 0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "cc by nc sa 4 0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "cc by nd 4 0"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "cc by sa 3 0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "cc by sa 4 0"),
    "CC0-1.0": ("CC0 1.0", "cc0 1 0"),
    "CDDL-1.0": ("Common Development and Distribution License, version 1.0", "common development distribution 1 0"),
    "CECILL-2.1": ("CeCILL License, version 2.1", "cecill 2 1"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "eclipse 1 0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "eclipse 2 0"),
    "EUPL-1.2": ("European Union Public License, version 1.2", "european union 1 2"),
    "GFDL-1.3": ("GNU Free Documentation License, version 1.3", "gnu free documentation 1 3"),
    "GPL-2.0": ("GNU General Public License, version 2", "gnu general 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "gnu general 3"),
    "ISC": ("ISC License", "isc"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "gnu lesser 2 1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "gnu lesser 3"),
    "LPPL-1.3c": ("LaTeX Project Public License, version 1.3c", "latex project 1 3c"),
    "MIT": ("MIT License", "mit"),
    "MIT-0": ("MIT No Attribution License", "mit no attribution"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "mozilla 1 1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "mozilla 2 0"),
    "MS-PL": ("Microsoft Public License", "microsoft public"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "ncsa"),
    "ODbL-1.0": ("Open Data Commons Open Database License, version 1.0", "open database 1 0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "open font 1 1"),
    "OSL-3.0": ("Open Software License, version 3.0", "open software 3 0"),
    "PSF-2.0": ("Python Software Foundation License, version 2", "python foundation 2"),
    "PostgreSQL": ("PostgreSQL License", "postgresql"),
    "Unlicense": ("Unlicense", "unlicense"),
    "Vim": ("Vim License", "vim"),
    "WTFPL": ("Do What The F*ck You Want To Public License", "do what want"),
    "Zlib": ("zlib License", "zlib"),
}
#: Sentences of licences and notices, with the words that must not be missing (none: any).
SENTENCES = {
    "Apache-2.0": [("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache 2 0")],
    "MIT": [("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "hereby granted charge person")],
    "GPL-3.0": [("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "gnu general 3")],
    "GPL-2.0": [("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "gnu general 2")],
    "BSD-3-Clause": [("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary modification")],
    "MPL-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla source form")],
    "CC-BY-4.0": [("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0")],
    "CC-BY-SA-4.0": [("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike 4 0")],
    "CC-BY-NC-4.0": [("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial 4 0")],
    "CC0-1.0": [("This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.", "public domain dedication")],
    "ISC": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee hereby granted")],
    "Unlicense": [("This is free and unencumbered software released into the public domain.", "unencumbered public domain")],
    "EPL-2.0": [("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2 0")],
    "Zlib": [("In no event will the authors be held liable for any damages arising from the use of this software.", "authors liable arising")],
    "Proprietary": [("All rights reserved.", "rights reserved"), ("All rights reserved. No part of this work may be reproduced without permission of the copyright holder.", "rights reserved reproduced permission")],
}
#: How notices name a licence.
FORMS = ("Licensed under the {}.", "This work is licensed under the {}.", "Released under the {}.")


def templates_of(names=NAMES, sentences=SENTENCES) -> dict[str, list[tuple[str, str]]]:
    """licence -> (text, words that must not be missing) of its notices, by FORMS, and sentences; and the SPDX tag."""
    out: dict[str, list[tuple[str, str]]] = {k: list(v) for k, v in sentences.items()}
    for k, (name, words) in names.items():
        tag = f"SPDX-License-Identifier: {k}"
        own = [(form.format(name).replace("the CC", "CC").replace("the Unlicense", "Unlicense"), words) for form in FORMS]
        out.setdefault(k, []).extend([*own, (tag, " ".join(re.findall("[a-z0-9]+", tag.lower())))])
    return out


TEMPLATES = templates_of()
NOT_TERM = "[^a-z0-9]+"
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)s?([-._].*)?$"
NO_STRINGS = "CAST(array() AS array<string>)"


def terms_of(c):
    return F.filter(F.split(ascii_lower(c), NOT_TERM), lambda t: t != "")


def statements(c):
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\n|(?<=[.!?;])[\x20\t]+"), lambda s: s.rlike("[A-Za-z0-9]"))


def template_terms(spark, templates) -> DataFrame:
    rows = [(name, i, t, words.split()) for name, texts in sorted(templates.items()) for i, (t, words) in enumerate(texts)]
    # a template of several sentences counts by its sentences together: one vector
    df = spark.createDataFrame(rows, "license string, variant int, t string, words array<string>")
    each = df.select("license", "variant", "words", F.explode(terms_of(F.col("t"))).alias("term")).groupBy("license", "variant", "words", "term").agg(F.count("*").alias("tf"))
    return each.select("license", "variant", "term", "tf", F.array_contains("words", F.col("term")).alias("must"), F.size("words").alias("n_must"))


def own_licences(files: DataFrame, id_col: str, text_col: str, path_col: str, templates, least: float) -> DataFrame:
    """id, path, license, similarity of every file."""
    spark = files.sparkSession
    tmpl = cut(template_terms(spark, templates), "templates")
    vocabulary = sorted(r.term for r in tmpl.select("term").distinct().collect())  # the templates' terms alone
    held = F.array(*[F.lit(t) for t in vocabulary])
    texts = files.select(F.col(text_col).alias("t"))
    seen = texts.select(F.explode_outer(F.array_intersect(F.split(ascii_lower(F.coalesce("t", F.lit(""))), NOT_TERM), held)).alias("term")).where("term IS NOT NULL")
    df = seen.groupBy("term").agg(F.count("*").alias("df"))
    n = files.count()
    idf = cut(tmpl.select("term").distinct().join(df, "term", "left").select("term", F.log1p(F.lit(float(n)) / (1 + F.coalesce("df", F.lit(0)))).alias("idf")), "idf")
    weights = tmpl.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    each = Window.partitionBy("license", "variant")
    order = each.orderBy(F.desc("w"), "term")
    ranked = weights.withColumn("all2", F.sum(F.col("w") * F.col("w")).over(each)).withColumn("above2", F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut(ranked.withColumn("key", F.col("all2") - F.coalesce("above2", F.lit(0.0)) >= F.lit(least * least) * F.col("all2")), "weights")
    keys = sorted(r.term for r in ranked.where("key").select("term").distinct().collect())
    hit = "(?i)(?<![A-Za-z0-9])(" + "|".join(keys) + ")(?![A-Za-z0-9])"

    narrow = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), F.when(F.coalesce(F.col(text_col), F.lit("")).rlike(hit), F.filter(statements(F.col(text_col)), lambda s: s.rlike(hit))).otherwise(F.expr(NO_STRINGS)).alias("units"))
    narrow = cut(narrow, "statements")
    # equal statements are scored once
    units = narrow.select(F.explode("units").alias("u")).distinct()
    vec = units.select("u", F.explode(terms_of(F.col("u"))).alias("term")).groupBy("u", "term").agg(F.count("*").alias("tf"))
    vec = vec.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log1p(F.lit(float(n)))))
    lengths = vec.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = ranked.select("term", "license", "variant", "must", "n_must", F.col("w").alias("tw"), F.sqrt("all2").alias("tnorm"))
    dots = vec.join(F.broadcast(side), "term").groupBy("u", "license", "variant", "tnorm", "n_must").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.count_if("must").alias("found"))
    dots = dots.where("found = n_must")
    scored = dots.join(lengths, "u").withColumn("cos", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9)).where(F.col("cos") >= least)
    best = scored.groupBy("u").agg(F.min(F.struct((-F.col("cos")).alias("c"), "license")).alias("x")).select("u", "x.license", (-F.col("x.c")).alias("cos"))
    some = F.size("units") > 0
    rows = narrow.where(some).withColumn("mark", F.xxhash64("units"))
    of_row = rows.select("mark", F.explode("units").alias("u")).distinct().join(best, "u")
    of_row = of_row.groupBy("mark").agg(F.min(F.struct((-F.col("cos")).alias("c"), "license")).alias("x")).select("mark", "x.license", (-F.col("x.c")).alias("similarity"))
    # files without a statement to score have nothing to look up, and would all meet under one mark
    none = narrow.where(~some).select("doc_id", "path", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("similarity"))
    return rows.join(of_row, "mark", "left").select("doc_id", "path", "license", "similarity").unionByName(none)


def inherited(own: DataFrame) -> DataFrame:
    """own with license_source: 'own', the directory that it comes from, or null."""
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = cut(own.withColumn("dir", F.when(F.col("path").isNotNull(), parent)), "own")
    given = rows.where(F.col("license").isNotNull() & F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE))
    given = cut(given.groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("similarity")).alias("c"), "license")).alias("x")).select("from_dir", F.col("x.license").alias("dir_license"), (-F.col("x.c")).alias("dir_similarity")), "given")
    dirs = rows.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))).alias("x")).select("dir", "x.depth", "x.up")
    near = ups.join(given, ups.up == given.from_dir).groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license", "dir_similarity")).alias("g"))
    near = cut(near.select(F.col("dir").alias("d"), "g.from_dir", "g.dir_license", "g.dir_similarity"), "near")
    out = rows.join(near, F.expr("license IS NULL AND dir = d"), "left")
    return out.select(
        "doc_id", "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("similarity", "dir_similarity").alias("similarity"),
        F.when(F.col("license").isNotNull(), F.lit("own")).otherwise(F.col("from_dir")).alias("license_source"),
    )


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates=None, least: float = 0.7) -> DataFrame:
    """doc_id, path, license, similarity, license_source: one row per file."""
    return inherited(own_licences(files, id_col, text_col, path_col, templates or TEMPLATES, least))


def oracle_sql(path: str, templates=None, least: float = 0.7) -> str:
    """DuckDB: scan() over documents whose path is the given expression, every statement scored; similarities to 6 digits."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {i}, {quoted(t)}, {words.split()})" for name, texts in sorted((templates or TEMPLATES).items()) for i, (t, words) in enumerate(texts))
    split = lambda c: f"list_filter(regexp_split_to_array(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH t(license, variant, t, words) AS (VALUES {rows}),
tt AS (SELECT license, variant, term, count(*) AS tf FROM (SELECT license, variant, unnest({split('t')}) AS term FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {path} AS path FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT r, unnest(list_distinct({split('text')})) AS term FROM d) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln(1 + n / (1 + coalesce(df, 0))) AS idf FROM tt LEFT JOIN df USING (term), n),
w AS (SELECT license, variant, term, tf * idf AS w FROM tt JOIN idf USING (term)),
wn AS (SELECT license, variant, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
s AS (SELECT r, unnest(regexp_split_to_array(regexp_replace(text, '([.!?;])[ \t]+', '\\1' || chr(10), 'g'), chr(10))) AS u FROM d),
su AS (SELECT DISTINCT u FROM s WHERE regexp_matches(u, '[A-Za-z0-9]')),
v AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest({split('u')}) AS term FROM su) GROUP BY ALL),
vw AS (SELECT u, v.term, tf * coalesce(idf, ln(1 + n)) AS w FROM v LEFT JOIN idf ON v.term = idf.term, n),
vn AS (SELECT u, sqrt(sum(w * w)) AS norm FROM vw GROUP BY u),
c AS (SELECT u, license, round(dot / (vn.norm * wn.norm), 9) AS cos FROM (SELECT u, license, variant, sum(vw.w * w.w) AS dot, list(term) AS terms FROM vw JOIN w USING (term) GROUP BY ALL) JOIN vn USING (u) JOIN wn USING (license, variant) JOIN t USING (license, variant) WHERE list_has_all(terms, words)),
b AS (SELECT r, license, cos FROM s JOIN c USING (u) WHERE cos >= {least} QUALIFY row_number() OVER (PARTITION BY r ORDER BY cos DESC, license) = 1),
own AS (SELECT d.r, doc_id, path, license, cos, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM d LEFT JOIN b USING (r)),
given AS (SELECT dir, license, cos FROM own WHERE license IS NOT NULL AND path IS NOT NULL AND regexp_matches(name, '(?i)^(un)?(licen[cs]e|copying|copyright|notice)s?([-._].*)?$') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cos DESC, license) = 1),
near AS (SELECT own.r, given.dir, given.license, given.cos FROM own JOIN given ON own.license IS NULL AND (given.dir = '' OR given.dir = own.dir OR starts_with(own.dir, given.dir || '/')) WHERE own.path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY own.r ORDER BY length(given.dir) DESC) = 1)
SELECT doc_id, path, coalesce(own.license, near.license) AS license, round(coalesce(own.cos, near.cos), 6) AS similarity, CASE WHEN own.license IS NOT NULL THEN 'own' ELSE near.dir END AS license_source
FROM own LEFT JOIN near USING (r)
"""
