import math
import re
from collections import Counter

from quillmere.llm.licenses import TEMPLATES, licence_scan, score_notices

SCHEMA = "doc_id long, path string, text string, licence string"


def test_cosines_against_plain(spark):
    texts = ["Released under the MIT License.", "Released under the MIT License.", "Apache License", "license of nobody in particular", ""]
    got = {r.notice: (r.licence, r.cosine) for r in score_notices(spark.createDataFrame([(t,) for t in texts], "notice string")).collect()}
    terms = lambda t: Counter(x for x in re.split("[^a-z0-9]+", t.lower()) if x)
    corpus = [terms(t) for t in texts if t] + [terms(t) for own in TEMPLATES.values() for t in own]
    df = Counter(w for d in corpus for w in d)
    idf = {w: math.log((len(corpus) + 1) / (n + 1)) + 1 for w, n in df.items()}
    vec = lambda c: {w: n * idf[w] for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for t in set(texts) - {""}:
        a = vec(terms(t))
        best = min((-round(sum(a[w] * b.get(w, 0) for w in a) / norm(a) / norm(b), 6), name) for name, b in ((n, vec(terms(x))) for n, own in TEMPLATES.items() for x in own))
        assert got[t][0] == best[1] and abs(got[t][1] + best[0]) < 2e-6
    assert "" not in got


def test_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", TEMPLATES["MIT"][1], "x"), (2, "a/b/c/file.txt", "plain text", "x"), (3, "a/b/COPYING.txt", TEMPLATES["GPL-3.0"][1], "x"),
        (4, "a/file", "text\nLicensed under the Apache License, Version 2.0.", None), (5, "d/file", "no notice", None), (6, None, "text", None), (7, "a/b/x", None, None),
        (8, "a/b/x", None, None), (9, "ab/file", "text", None), (10, "top", "text", None), (11, "z/LICENSE", "", None), (12, "z/q", "y " * 100_000, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.licence, r.how, r.from_dir) for r in licence_scan(df).collect()}
    assert got[1][:2] == ("MIT", "own") and got[3][:2] == ("GPL-3.0", "own") and got[4] == ("Apache-2.0", "own", None)
    assert got[2] == ("GPL-3.0", "inherited", "a/b") and got[7] == got[8] == ("GPL-3.0", "inherited", "a/b")
    assert all(got[k] == (None, None, None) for k in (5, 6, 9, 10, 11, 12))
    root = spark.createDataFrame([*rows, (20, "LICENSE", TEMPLATES["MIT"][1], "x")], SCHEMA)
    got = {r.doc_id: (r.licence, r.how, r.from_dir) for r in licence_scan(root).collect()}
    assert got[5] == ("MIT", "inherited", "") and got[2][2] == "a/b" and got[6] == (None, None, None)


def test_first_speaks_and_empty(spark):
    df = spark.createDataFrame([(1, "s/e/1", "Released under the MIT License.", ""), (2, "s/e/2", "x", ""), (3, "s/e/3", "Licensed under the Apache License, Version 2.0.", ""), (3, "s/e/3", "Licensed under the Apache License, Version 2.0.", "")], SCHEMA)
    got = sorted((r.doc_id, r.licence, r.how) for r in licence_scan(df, speaks="first").collect())
    assert got == [(1, "MIT", "own"), (2, "MIT", "inherited"), (3, "Apache-2.0", "own"), (3, "Apache-2.0", "own")]
    assert licence_scan(df.limit(0)).count() == 0


def test_headers_wherever_they_stand(spark):
    prose = "some prose about the weather in the valley and what people of the town said to the others. " * 12
    bsd = """/*
 * Copyright (c) 2020, Somebody
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met: Redistributions of source code must retain the above copyright
 * notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright
 * notice, this list of conditions and the following disclaimer in the
 * documentation and/or other materials provided with the distribution.
 */
"""
    mit = "Copyright 2019 Somebody Else\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.\n"
    free = "This is free and unencumbered software released into the public domain.\n"
    inside = prose + "Licensed under the Apache License, Version 2.0. " + prose  # one very long line
    rows = [(1, "a/1", bsd + prose, ""), (2, "b/2", prose + "\n" + mit + prose, ""), (3, "c/3", free + "\n" + prose, ""), (4, "d/4", inside * 3, ""), (5, "e/5", prose, ""), (6, "f/6", "he used the source and the form of the words", "")]
    got = {r.doc_id: (r.licence, r.how) for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("BSD-2-Clause", "own"), 2: ("MIT", "own"), 3: ("Unlicense", "own"), 4: ("Apache-2.0", "own"), 5: (None, None), 6: (None, None)}


def test_a_licence_in_most_files(spark):
    """What most files carry is named all the same."""
    rows = [(k, f"s{k}/x", f"prose {k} words\nLicensed under CC BY-NC 4.0.\nmore", "") for k in range(60)] + [(100, "t/y", "Licensed under CC BY 4.0.", "")]
    got = {r.doc_id: r.licence for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == "CC-BY-NC-4.0" for k in range(60)) and got[100] == "CC-BY-4.0"


def test_notices_inside_long_lines(spark):
    words = " ".join(f"word{k}" for k in range(100))
    texts = {
        1: f"{words} Released under the MIT License {words}", 2: f"{words}. Released under the MIT License {words}", 3: f"Released under the MIT License {words} and {words}",
        4: f"{words} and then the Software is of the people {words}", 5: f"{words} Licensed under the Apache License Version 2.0 {words} " * 3, 6: words * 3,
    }
    rows = [(k, f"d{k}/x", t, "") for k, t in texts.items()]
    got = {r.doc_id: r.licence for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "Apache-2.0", 6: None}
