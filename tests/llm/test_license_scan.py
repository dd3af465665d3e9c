"""Cosines against brute force, and inheritance along directories."""

import math
import re
from collections import Counter

import pytest

from conftest import SMALL

from sparrowtext.llm import license_scan as ls

SCHEMA = "doc_id long, text string, path string"
PROSE = "A walk by the river in spring. Nothing else happened there; we went home.\nThe end of it"


def terms(text):
    return [t for t in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if t]


def brute(texts, templates, least):
    """The best (license, cosine) of each text."""
    vectors = [(name, Counter(terms(t)), set(words.split())) for name, ts in templates.items() for t, words in ts]
    vocabulary = {t for _, v, _ in vectors for t in v}
    df = Counter(t for x in texts for t in set(terms(x or "")) & vocabulary)
    n = len(texts)
    idf = {t: math.log1p(n / (1 + df[t])) for t in vocabulary}
    w = lambda v: {t: k * idf.get(t, math.log1p(n)) for t, k in v.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    weighted = [(name, w(v), must) for name, v, must in vectors]
    out = []
    for x in texts:
        best = None
        for unit in re.split(r"\n|(?<=[.!?;])[\x20\t]+", x or ""):
            u = w(Counter(terms(unit)))
            for name, v, must in weighted if u else ():
                if not must <= u.keys():
                    continue
                c = round(sum(k * v.get(t, 0) for t, k in u.items()) / (norm(u) * norm(v)), 9)
                if c >= least and (best is None or (-c, name) < best):
                    best = (-c, name)
        out.append((best[1], -best[0]) if best else (None, None))
    return out


def close(got, want):
    return got[0] == want[0] and (got[1] is None) == (want[1] is None) and (got[1] is None or abs(got[1] - want[1]) < 1e-6)


def test_cosines(spark):
    texts = [
        "Licensed under the MIT License.", PROSE + "\nLicensed under the Apache License, Version 2.0.", "# Licensed under the Apache License version 2.0", "the license of the public domain was under work", None, "", "  \n ",
        "All rights reserved.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "LICENSED UNDER THE BSD 2-CLAUSE LICENSE", PROSE, "x " * 5000 + "\nReleased under the MIT License.", "license " * 30,
    ] + [PROSE + f" w{i}" for i in range(40)]
    files = spark.createDataFrame([(i, t, f"d/{i}") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.license, r.similarity) for r in ls.own_licences(files, "doc_id", "text", "path", ls.TEMPLATES, 0.7).collect()}
    for i, want in enumerate(brute(texts, ls.TEMPLATES, 0.7)):
        assert close(got[i], want), (texts[i][:60] if texts[i] else None, got[i], want)
    assert [got[i][0] for i in (0, 1, 7, 8, 9, 10, 11)] == ["MIT", "Apache-2.0", "Proprietary", "CC-BY-NC-4.0", "GPL-3.0", "BSD-2-Clause", None]


def test_a_frame_without_the_name_is_no_licence():
    texts = ["All rights are reserved for the winners.", "Licensed under the Foo License, Version 2.0.", "Licensed under the BSD License.", "Released under the terms of the treaty.", "This work is licensed under the terms of a contract.", "Licensed under the Apache License.", "The MIT press published it."]
    assert [x for x, _ in brute(texts + [PROSE + str(i) for i in range(300)], ls.TEMPLATES, 0.7)[:len(texts)]] == [None] * len(texts)
    assert len(ls.TEMPLATES) >= 40
    got = brute(["Licensed under the Artistic License 2.0.", "Released under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: MIT", "Licensed under CC BY-NC 4.0."] + [PROSE] * 300, ls.TEMPLATES, 0.7)
    assert [x for x, _ in got[:4]] == ["Artistic-2.0", "LGPL-3.0", "MIT", "CC-BY-NC-4.0"]


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, mit, "LICENSE"), (2, PROSE, "a.txt"), (3, PROSE, "src/deep/b.txt"), (4, apache, "lib/COPYING.md"), (5, PROSE, "lib/x/y/c.txt"), (6, PROSE + "\n" + mit, "lib/d.txt"), (7, PROSE, None), (8, None, "lib/e.txt"),
        (9, PROSE, "library/f.txt"), (10, PROSE, "/abs/g.txt"), (None, PROSE, "lib/x/h.txt"), (5, PROSE, "lib/x/y/c.txt"), (11, PROSE, "lib/x/LICENSE.txt"), (12, apache, "sub/notlicense.txt"), (13, PROSE, "sub/k.txt"),
    ]
    files = spark.createDataFrame([(*r, 1, "z", "z") for r in rows], SCHEMA + ", u int, dir string, license string")
    got = sorted(((r.doc_id, r.path, r.license, r.license_source) for r in ls.scan(files).collect()), key=repr)
    want = [
        (1, "LICENSE", "MIT", "own"), (2, "a.txt", "MIT", ""), (3, "src/deep/b.txt", "MIT", ""), (4, "lib/COPYING.md", "Apache-2.0", "own"), (5, "lib/x/y/c.txt", "Apache-2.0", "lib"), (6, "lib/d.txt", "MIT", "own"), (7, None, None, None),
        (8, "lib/e.txt", "Apache-2.0", "lib"), (9, "library/f.txt", "MIT", ""), (10, "/abs/g.txt", "MIT", ""), (None, "lib/x/h.txt", "Apache-2.0", "lib"), (5, "lib/x/y/c.txt", "Apache-2.0", "lib"), (11, "lib/x/LICENSE.txt", "Apache-2.0", "lib"),
        (12, "sub/notlicense.txt", "Apache-2.0", "own"), (13, "sub/k.txt", "MIT", ""),
    ]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "text", "CAST(NULL AS string) AS path")
    rows = docs.collect()
    got = {r.doc_id: (r.license, r.similarity) for r in ls.scan(docs).collect()}
    for r, want in zip(rows, brute([r.text for r in rows], ls.TEMPLATES, 0.7)):
        assert close(got[r.doc_id], want), (r.doc_id, got[r.doc_id], want)


def test_no_python_in_the_plan(spark):
    plan = ls.scan(spark.createDataFrame([(1, "Licensed under the MIT License.", "a/b")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_templates_find_themselves(name):
    for t, _ in ls.TEMPLATES[name]:
        got = brute([t, *[PROSE] * 20], ls.TEMPLATES, 0.7)[0]
        assert got[0] == name, (t, got)
