import math
from collections import Counter

import pytest

from scoreloom.llm import licences as lc


def dense(matcher, text):
    """All windows of all lines against all templates, without any skipping."""
    best = {}
    for line in (text or "").lower().split("\n"):
        ts = lc.terms(line)
        for name, vector, norm, size in matcher.templates:
            for a, b in {(0, len(ts))} | {(p, p + size) for p in range(len(ts) - size + 1)}:
                w = {t: c * matcher.idf(t) for t, c in Counter(ts[a:b]).items()}
                if not w:
                    continue
                c = sum(v * vector.get(t, 0) for t, v in w.items()) / norm / math.sqrt(sum(v * v for v in w.values()))
                if c >= matcher.least:
                    best[name] = max(best.get(name, 0), c)
    return best


TEXTS = [
    "Some words.\nReleased under the MIT License.\nMore words.",
    "prefix text Licensed under the Apache License, Version 2.0. suffix text that goes on and on",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under CC BY-NC 4.0",
    "the of and under this is work version 3 2.0 public general",
    "All rights reserved.\nLicensed under CC BY 4.0.",
    "nothing at all",
    None,
    "",
    "word " * 30_000 + "\nReleased under the MIT License.",
]


def test_skipping_loses_nothing():
    n = len(TEXTS)
    df = {t: sum(t in lc.terms(x or "") for x in TEXTS) for _, text in lc.TEMPLATES for t in lc.terms(text)}
    m = lc.Matcher(df, n, lc.TEMPLATES, 0.7)
    for text in TEXTS[:9]:
        got, want = dict(m.match(text)), dense(m, text)
        assert got.keys() == want.keys()
        for k in got:
            assert got[k] == pytest.approx(want[k])
    assert m.match(TEXTS[0])[0][0] == "MIT"
    assert m.match(TEXTS[1])[0][0] == "Apache-2.0"
    assert m.match(TEXTS[2])[0][0] == "GPL-3.0"
    assert m.match(TEXTS[3])[0][0] == "CC-BY-NC-4.0"


def test_inheritance_by_path(spark):
    mit, gpl = TEXTS[0], TEXTS[2]
    rows = [
        ("LICENSE", 1, mit), ("a/x.txt", 2, "plain"), ("a/b/COPYING", 3, gpl), ("a/b/c/d/y.txt", 4, None), ("a/b/z.txt", 5, TEXTS[3]),
        ("ab/q.txt", 6, ""), (None, 7, "plain"), (None, 8, mit), ("a/b/LICENSE.md", 9, "no statement"), ("a/b/z.txt", 5, TEXTS[3]),
    ] + [(f"f{i}", 100 + i, "filler text") for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "path string, doc_id long, text string, own string")
    got = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in lc.licence_scan(df).collect()}
    assert got[1] == ("MIT", "own", None)
    assert got[2] == ("MIT", "directory", "")
    assert got[4] == ("GPL-3.0", "directory", "a/b")
    assert got[5] == ("CC-BY-NC-4.0", "own", None)
    assert got[6] == ("MIT", "directory", "")
    assert got[7] == (None, "none", None)
    assert got[8] == ("MIT", "own", None)
    assert got[9] == ("GPL-3.0", "directory", "a/b")
    assert lc.licence_scan(df).count() == len(rows)
    assert lc.licence_scan(df.limit(0)).count() == 0


BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
FULL = "                    GNU {}GENERAL PUBLIC LICENSE\n                       Version {}\n\n Copyright (C) 2007 Free Software Foundation, Inc."


def test_wrapped_statements_and_licence_files():
    m = lc.Matcher({}, 100, lc.TEMPLATES, lc.LEAST)
    said = {
        "BSD-3-Clause": [BSD, "import os\n" + BSD + "\ncode\n"],
        "GPL-3.0": [GPL, "/*\n" + GPL + "\n */\nint main;", FULL.format("", "3, 29 June 2007")],
        "GPL-2.0": [GPL.replace("version 3", "version 2"), FULL.format("", "2, June 1991")],
        "LGPL-3.0": [GPL.replace("General", "Lesser General"), FULL.format("LESSER ", "3, 29 June 2007")],
        "Apache-2.0": ["                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n", "// Licensed under the\n// Apache License, Version 2.0."],
        "MPL-2.0": ["Mozilla Public License Version 2.0\n====\n1. Definitions"],
        "MIT": ["The MIT License (MIT)\n\nCopyright (c) x", "Released under\nthe MIT\nLicense."],
    }
    for name, texts in said.items():
        for text in texts:
            assert m.match(text)[:1] and m.match(text)[0][0] == name, text


def across(matcher, text):
    """All windows of the whole text, and all lines, without any skipping."""
    best, ts = dense(matcher, text), lc.terms((text or "").lower())
    for name, vector, norm, size in matcher.templates:
        for p in range(max(1, len(ts) - size + 1)):
            c = matcher.cosine(Counter(ts[p : p + size]), vector, norm) if ts else 0
            if c >= matcher.least:
                best[name] = max(best.get(name, 0), c)
    return best


def test_skipping_loses_nothing_across_lines():
    import random

    rng = random.Random(1)
    for least in (0.5, 0.8):
        m = lc.Matcher({"the": 90, "license": 40, "under": 50}, 100, lc.TEMPLATES, least)
        for _ in range(60):
            ws = [w for _, t in rng.choices(lc.TEMPLATES, k=3) for w in [*t.split(), *rng.choices(["the", "x", "license", "under"], k=3)] if rng.random() > 0.1]
            text = "".join(w + rng.choice([" ", " ", "\n"]) for w in ws)
            got, want = dict(m.match(text)), across(m, text)
            assert got.keys() == want.keys()
            assert all(got[k] == pytest.approx(want[k]) for k in got)
