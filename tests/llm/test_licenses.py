import re

from spotframe.llm import licenses


def plain(text):
    """The base, read literally: words, places of phrases, labels."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = []
    for phrase, label in licenses.BASE:
        p = phrase.split(" ")
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(base)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    return licenses.scan(df).collect()


TEXTS = ["", None, "MIT License mit  license, mit\nlicense", "license mit", "Apache-License. the (GENERAL) public\tLicense", "mit licenseé ñ x", "general public", "mit license" * 3, "x" * 5000 + " mit license", "ﬀ İ MIT-LICENSE", "license"]


def test_base(spark):
    rows = list(enumerate(TEXTS))
    for r in run(spark, rows):
        assert (r.n_words, sorted((b.at, b.label) for b in r.base)) == plain(TEXTS[r.doc_id])


def test_rules(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
        "GNU Lesser General Public License version 2.1 or later": {"lgpl-2.1-or-later"},
        "licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "SPDX-License-Identifier: GPL-2.0-or-later\n": {"gpl-2.0-or-later"},
        "Licensed under CC BY-NC 4.0. All rights reserved": {"cc-by-nc-4.0", "proprietary"},
        "Released under the MIT License. mitten": {"mit"},
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": {"mpl-2.0"},
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": {"spdx-either"},
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": {"spdx-exception"},
        "Neither the name of the X Group nor the names of its contributors may be used to endorse or promote products": {"bsd-3-clause"},
        "This library is free software; you can redistribute it and/or modify it": {"lgpl"},
        "no such words": set(),
    }
    rows = list(enumerate(texts))
    for r in run(spark, rows):
        assert {f.label for f in r.found} == texts[rows[r.doc_id][1]], rows[r.doc_id]


def test_spans_are_code_points_and_suppressed(spark):
    text = "é\x01ñ Released under the MIT License and x; mit license"
    (r,) = run(spark, [(1, text)])
    assert [text[f.start : f.stop] for f in r.found] == ["Released under the MIT License", "mit license"]


def test_table_and_repeats(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, *plain(t)) for d, t in rows + rows[:3])
    assert sorted((r.doc_id, r.n_words, sorted((b.at, b.label) for b in r.base)) for r in run(spark, rows + rows[:3])) == want
    assert run(spark, []) == []


def test_there_are_hundreds_of_rules():
    assert len(licenses.rules()) > 200


def test_suppression_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(0, [(0, -14, -50, "wide", 1.0, 0), (3, -11, -90, "mid", 1.0, 2), (6, -8, -80, "low", 1.0, 1)])]
    levels = [30, 50, 70, 90]
    for k in range(1, 60):
        hits = []
        for _ in range(rng.randrange(0, 40)):
            a, n, p = rng.randrange(60), rng.randrange(1, 30), rng.randrange(4)
            hits.append((a, -a - n, -levels[p], rng.choice("xyz"), 0.5, p))
        rows.append((k, hits))
    df = spark.createDataFrame(rows, f"id long, hits array<{licenses.HIT}>")
    for r in df.select("id", licenses.suppress(F.col("hits"), 4).alias("kept")).collect():
        hits = sorted(rows[r.id][1])
        want = []
        for i, (a, b, p, label, score, level) in enumerate(hits):
            over = [j for j, (c, d, q, *_) in enumerate(hits) if j != i and c <= a and -d >= -b and -q >= -p and ((c, d, q) != (a, b, p) or j < i)]
            if not over:
                want.append((a, b, p, label, score, level))
        assert [tuple(x) for x in r.kept] == want


def test_rules_on_table_against_python(spark, sf):
    """The whole of the method: every rule tried on every text, then suppression by comparing all pairs."""
    rules = [(r, re.compile(r.pattern)) for r in licenses.rules()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(90_000 + k, f"Released under the {t} License, version 2.0 or later; all rights reserved. SPDX-License-Identifier: MIT") for k, t in enumerate(("Apache", "GNU General Public", "Mozilla Public", "MIT"))]
    seen = 0
    for r in run(spark, docs):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in dict(docs)[r.doc_id] or "")
        hits = sorted((m.start(), -m.end(), -rule.priority, rule.label) for rule, p in rules for m in p.finditer(low) if m.end() > m.start())
        want = [x for i, x in enumerate(hits) if not any(j != i and y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] and (y[:3] != x[:3] or j < i) for j, y in enumerate(hits))]
        assert [(f.start, -f.stop, -f.priority, f.label) for f in r.found] == want
        seen += len(want)
    assert seen > 10


def test_very_long_text(spark):
    text = "x " * 300_000 + "MIT License " + "y " * 300_000
    (r,) = run(spark, [(1, text)])
    assert (r.n_words, [b.at for b in r.base], [f.label for f in r.found]) == (600_002, [300_000], ["mit"])


HEADERS = {
    "Permission is hereby granted, free of charge, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge": "mit",
    "The above copyright notice and this permission notice shall be included in all copies": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Redistribution and use in source and binary forms, with or without": "bsd",
    "Neither the name of the X Group nor the names of its contributors may be used to endorse or promote products derived": "bsd-3-clause",
    "This program is free software: you can redistribute it and/or modify it under": "gpl",
    "This library is free software; you can redistribute it and/or modify it": "lgpl",
    "You should have received a copy of the GNU Affero General Public License": "agpl",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS": "apache-2.0",
    "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements": "apache",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl-2.0",
    "Released under the MIT license": "mit",
    "Everyone is permitted to copy and distribute verbatim copies of this license document": "gpl",
    "This is free and unencumbered software released into the public domain": "unlicense",
}


def test_sentences_wrapped_anywhere_and_behind_comment_marks(spark):
    rows = []
    for text, label in HEADERS.items():
        words = text.split(" ")
        for mark in ("", "# ", " * ", "// ", ";; ", "-- ", "% "):
            rows += [(label, mark + " ".join(words[:i]) + "\n" + mark + " ".join(words[i:])) for i in range(1, len(words))]
            rows.append((label, mark + f"\n{mark}".join(words)))
    for r in run(spark, [(i, t) for i, (_, t) in enumerate(rows)]):
        assert rows[r.doc_id][0] in {f.label for f in r.found}, rows[r.doc_id]


def test_gates_hold_one_word():
    assert not [r for r in licenses.rules() if " " in r.keyword]
