"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory; DataFrame operations only.

1. Texts are cut into units (lines and sentences; longer ones in pieces). Units of which a good part are pairs of neighbouring terms that
   some template has too are candidates, and runs of candidates are a file's notices, wherever they stand in it (a file that is itself
   a licence file is one notice, whole). The pairs come from the templates, so no list of words decides what is looked at.
2. Notices become sparse TF-IDF vectors, joined by term with those of the templates; the best cosine above the threshold names the licence.
3. A file without one inherits from the licence file of the nearest directory above it, found by joins of paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, read_table

#: Notices of common licences as they stand in file headers and licence files, by SPDX name.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-3-Clause": (
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Licensed under the 2-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": ("Copyright. All rights reserved. No part may be reproduced without permission of the owner.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Least cosine of a notice that names a licence.
THRESHOLD = 0.5
#: A line or sentence of more than ``UNIT`` terms is taken by its stretches: template pairs at most ``REACH`` terms apart. A unit belongs to a
#: notice with at least two different pairs of the templates, if they are at least this share of its pairs; units of a run are at most
#: ``GAP`` apart.
UNIT, REACH, LEAST_PAIRS, LEAST_SHARE, GAP = 32, 4, 2, 0.25, 2
_SPLIT, _UNITS = "[^a-z0-9]+", r"\n|[.;!?]\s"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _terms(notice: Column) -> Column:
    return F.filter(F.split(F.lower(notice), _SPLIT), lambda t: F.length(t) > 0)


def _known(spark, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row for each template: ``licence``, ``template`` (a number), ``notice``."""
    rows = [(name, n, text) for name, texts in sorted(templates.items()) for n, text in enumerate([texts] if isinstance(texts, str) else texts)]
    return spark.createDataFrame(rows, "licence string, template int, notice string")


def template_pairs(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[str]:
    """The pairs of neighbouring terms of the templates."""
    texts = [x for own in templates.values() for x in ([own] if isinstance(own, str) else own)]
    terms = [[t for t in re.split(_SPLIT, x.lower()) if t] for x in texts]
    return sorted({f"{a} {b}" for ts in terms for a, b in zip(ts, ts[1:], strict=False)})


def _pairs(terms: Column) -> Column:
    """The terms' pairs of neighbours."""
    joined = lambda ts: F.transform(F.slice(ts, F.lit(1), F.greatest(F.size(ts) - 1, F.lit(0))), lambda t, k: F.concat_ws(" ", t, F.element_at(ts, k + 2)))
    return _let(terms, joined)


def units_of(text: Column, known: Column) -> Column:
    """The units of a text, each an array of terms: its lines and their sentences. Of a longer one than ``UNIT`` terms each stretch is a unit, from
    its first pair of ``known`` to its last, wherever it lies; one without any is an empty unit."""
    empty = F.array(F.array().cast("array<string>"))

    def stretches(terms: Column, pairs: Column, own: Column) -> Column:
        places = F.filter(F.transform(pairs, lambda p, k: F.when(F.array_contains(own, p), k)), lambda k: k.isNotNull())

        def between(at: Column) -> Column:
            apart = lambda a, b: F.coalesce(F.get(at, b) - F.get(at, a) > REACH, F.lit(True))
            first = F.filter(at, lambda x, n: apart(n - 1, n))
            last = F.filter(at, lambda x, n: apart(n, n + 1))
            return F.zip_with(first, last, lambda a, b: F.slice(terms, a + 1, b - a + 2))

        return _let(places, between)

    def cut(terms: Column) -> Column:
        long = _let(_pairs(terms), lambda pairs: _let(F.array_intersect(pairs, known), lambda own: F.when(F.size(own) > 0, stretches(terms, pairs, own)).otherwise(empty)))
        return F.when(F.size(terms) <= UNIT, F.array(terms)).otherwise(long)

    return F.flatten(F.transform(F.split(text, _UNITS, -1), lambda line: _let(_terms(line), cut)))


def notices(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``(path, key, notice)`` of ``files`` (``path``, ``key``, ``text``): the terms of each run of candidate units, joined by blanks.
    Files are told apart by path and text; repeated ones give their notices once."""
    known = F.array(*map(F.lit, template_pairs(templates)))
    shared = lambda terms: F.size(F.array_intersect(_pairs(terms), known))
    some = files.where(shared(_terms(F.col("text"))) >= LEAST_PAIRS)  # one look at the whole text spares most texts the rest
    units = some.select("path", "key", F.posexplode_outer(units_of(F.col("text"), known)).alias("unit", "terms"))
    told = units.where(shared(F.col("terms")) >= F.greatest(F.lit(LEAST_PAIRS), LEAST_SHARE * (F.size("terms") - 1))).dropDuplicates(["path", "key", "unit"])
    order = Window.partitionBy("path", "key").orderBy("unit")
    starts = (F.col("unit") - F.lag("unit").over(order) > GAP).cast("int")
    runs = told.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit", "terms"))), lambda u: u["terms"]))
    return runs.groupBy("path", "key", "run").agg(F.array_join(whole, " ").alias("notice")).select("path", "key", "notice")


def score_notices(texts: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(notice, licence, cosine)`` for each distinct notice of ``texts`` (``notice``) that shares a term with a template: the licence of
    the best template, ties by name. Document frequencies count every notice of the corpus as often as it occurs, and the templates once each.

    Equal notices are counted before they are taken apart, so one that a third of all files carry is scored once.
    """
    spark = texts.sparkSession
    known = _known(spark, templates or TEMPLATES)
    distinct = texts.where(F.length("notice") > 0).groupBy("notice").agg(F.count("*").alias("files"))
    distinct = materialize(distinct.withColumn("nid", F.monotonically_increasing_id()), "licence-notices")

    def counted(df: DataFrame, *ids: str) -> DataFrame:
        return df.select(*ids, F.explode(_terms(F.col("notice"))).alias("term")).groupBy(*ids, "term").agg(F.count("*").alias("tf"))

    of_notice = counted(distinct, "nid", "files")
    of_template = counted(known, "licence", "template")
    df = of_notice.select("term", F.col("files").alias("n")).unionByName(of_template.select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    total = (distinct.agg(F.sum("files")).first()[0] or 0) + known.count()
    idf = materialize(df.select("term", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "licence-idf")
    weigh = lambda x, *ids: x.join(idf, "term").select(*ids, "term", (F.col("tf") * F.col("idf")).alias("w"))
    a, b = weigh(of_notice, "nid"), weigh(of_template, "licence", "template")
    norm_a = a.groupBy("nid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_a"))
    norm_b = b.groupBy("licence", "template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_b"))
    dots = a.join(b.withColumnRenamed("w", "v"), "term").groupBy("nid", "licence", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosines = dots.join(norm_a, "nid").join(norm_b, ["licence", "template"]).select("nid", "licence", F.round(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), 6).alias("cosine"))
    best = cosines.groupBy("nid").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence"))).alias("best"))
    return distinct.join(best, "nid").select("notice", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"))


def licence_scan(files: DataFrame, licence_file: Column | None = None, speaks: str = "named", threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``files`` (``path``, ``text``, the columns in ``keep``): ``keep``, ``path``, ``licence``, ``cosine``, ``how``, ``from_dir``.

    ``how`` is ``own`` (the file's notice reaches the threshold), ``inherited`` (``from_dir`` is the nearest directory above, its own
    first, with a licence file) or null. ``licence_file`` tells licence files, by default by name. ``speaks='named'``: they speak for
    their directory; ``speaks='first'``: in trees without such files, the first directly licensed file of a directory, by path, does. A
    null path inherits nothing, a null text holds no notice; of several notices of a file the best counts, ties by name; several licence files in a directory: the best cosine, ties by path.
    """
    if licence_file is None:
        licence_file = F.coalesce(F.regexp_extract("path", "(?i)(?:^|/)((?:un)?licen[cs]e|copying|notice)(?:[.-][^/]*)?$", 1) != "", F.lit(False))
    rows = files.select(*keep, "path", F.coalesce("text", F.lit("")).alias("text"))
    # a file's directory: all before the last slash; the root is the empty string
    rows = rows.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    rows = rows.withColumns({"is_file": F.coalesce(licence_file, F.lit(False)), "key": F.xxhash64("text")})
    found = notices(rows.where(~F.col("is_file")))
    whole = rows.where(F.col("is_file")).select("path", "key", F.array_join(_terms(F.col("text")), " ").alias("notice")).distinct()
    found = materialize(found.unionByName(whole).where(F.length("notice") > 0).withColumn("n_key", F.xxhash64("notice")), "licence-notices")
    scored = score_notices(found.select("notice")).where(F.col("cosine") >= threshold)
    scored = materialize(scored.select(F.col("notice").alias("s_notice"), "licence", "cosine", F.xxhash64("notice").alias("s_key")), "licence-scores")
    named = found.join(scored, (F.col("n_key") == F.col("s_key")) & (F.col("notice") == F.col("s_notice")))
    best = named.groupBy(F.col("path").alias("b_path"), F.col("key").alias("b_key")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"))
    best = materialize(best.select("b_path", "b_key", "best.licence", (-F.col("best.c")).alias("cosine")), "licence-best")
    own = rows.select(*keep, "path", "dir", "is_file", "key").join(best, (F.col("key") == F.col("b_key")) & F.col("path").eqNullSafe(F.col("b_path")), "left")
    own = materialize(own.select(*keep, "path", "dir", "is_file", "licence", "cosine"), "licence-own")

    speaking = own.where(F.col("licence").isNotNull() & F.col("dir").isNotNull() & (F.col("is_file") if speaks == "named" else F.lit(True)))
    order = F.struct((-F.col("cosine")).alias("c"), F.col("path"), F.col("licence")) if speaks == "named" else F.struct(F.col("path"), F.lit(0).alias("z"), F.col("licence"))
    by_dir = speaking.groupBy("dir").agg(F.min(order).alias("best")).select(F.col("dir").alias("from_dir"), F.col("best.licence").alias("dir_licence"))
    # directories, far fewer than files, look up their ancestors; the longest that speaks is the nearest
    parts = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.array(F.lit("")))
    dirs = own.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = dirs.join(by_dir, F.col("up") == F.col("from_dir")).groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "dir_licence")).alias("near"))
    nearest = materialize(nearest.select(F.col("dir").alias("n_dir"), F.col("near.from_dir").alias("from_dir"), F.col("near.dir_licence").alias("dir_licence")), "licence-dirs")
    done = own.join(nearest, F.col("dir") == F.col("n_dir"), "left")
    has = F.col("licence").isNotNull()
    return done.select(
        *keep, "path",
        F.coalesce("licence", "dir_licence").alias("licence"), "cosine",
        F.when(has, "own").when(F.col("dir_licence").isNotNull(), "inherited").alias("how"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """The documents as files ``source/lang/doc_id``; in each directory the first licensed document speaks."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    return licence_scan(docs.select("doc_id", path.alias("path"), "text"), speaks="first")


def licence_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``op6_licenses``: the same units, vectors and directories by list functions and plain joins."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, {n}, {quote(text)})" for name, texts in sorted(TEMPLATES.items()) for n, text in enumerate(texts))
    pairs = ", ".join(map(quote, template_pairs()))
    terms = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '{_SPLIT}'), lambda t: t <> '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS dir, coalesce(source, 'unknown') AS up1,
                      concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), lpad(CAST(doc_id AS VARCHAR), 20, '0')) AS path, coalesce(text, '') AS text FROM documents),
    l AS (SELECT rid, unnest(regexp_split_to_array(text, '{_UNITS}')) AS line, generate_subscripts(regexp_split_to_array(text, '{_UNITS}'), 1) AS i FROM d),
    t AS (SELECT rid, i, {terms('line')} AS ts FROM l),
    h AS (SELECT rid, i, ts, j FROM (SELECT rid, i, ts, unnest(range(1, len(ts))) AS j FROM t WHERE len(ts) > {UNIT}) WHERE ts[j] || ' ' || ts[j + 1] IN ({pairs})),
    g AS (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY rid, i ORDER BY j) > {REACH} THEN 1 ELSE 0 END AS apart FROM h),
    e AS (SELECT *, sum(apart) OVER (PARTITION BY rid, i ORDER BY j ROWS UNBOUNDED PRECEDING) AS k FROM g),
    u AS (SELECT rid, i, 0 AS k, CASE WHEN len(ts) <= {UNIT} THEN ts ELSE [] END AS ts FROM t WHERE len(ts) <= {UNIT} OR (rid, i) NOT IN (SELECT (rid, i) FROM h)
          UNION ALL SELECT rid, i, k, any_value(ts)[min(j) : max(j) + 1] FROM e GROUP BY rid, i, k),
    n AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY i, k) AS unit, ts, list_transform(range(1, len(ts)), lambda j: ts[j] || ' ' || ts[j + 1]) AS ps FROM u),
    c AS (SELECT rid, unit, ts FROM n WHERE len(ts) > 1 AND len(list_intersect(list_distinct(ps), [{pairs}])) >= greatest({LEAST_PAIRS}, {LEAST_SHARE} * (len(ts) - 1))),
    s AS (SELECT *, CASE WHEN unit - lag(unit) OVER (PARTITION BY rid ORDER BY unit) > {GAP} THEN 1 ELSE 0 END AS starts FROM c),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY unit ROWS UNBOUNDED PRECEDING) AS run FROM s),
    f AS (SELECT rid, string_agg(array_to_string(ts, ' '), ' ' ORDER BY unit) AS notice FROM r GROUP BY rid, run),
    q AS (SELECT notice, count(*) AS files FROM f GROUP BY notice),
    k(licence, template, notice) AS (VALUES {known}),
    ta AS (SELECT notice, files, term, count(*) AS tf FROM (SELECT notice, files, unnest(string_split(notice, ' ')) AS term FROM q) GROUP BY ALL),
    tb AS (SELECT licence, template, term, count(*) AS tf FROM (SELECT licence, template, unnest({terms('notice')}) AS term FROM k) GROUP BY ALL),
    df AS (SELECT term, sum(n) AS df FROM (SELECT term, files AS n FROM ta UNION ALL SELECT term, 1 FROM tb) GROUP BY term),
    idf AS (SELECT term, ln(((SELECT coalesce(sum(files), 0) FROM q) + (SELECT count(*) FROM k) + 1.0) / (df + 1.0)) + 1.0 AS idf FROM df),
    a AS (SELECT notice, term, tf * idf AS w FROM ta JOIN idf USING (term)), b AS (SELECT licence, template, term, tf * idf AS w FROM tb JOIN idf USING (term)),
    na AS (SELECT notice, sqrt(sum(w * w)) AS n FROM a GROUP BY 1), nb AS (SELECT licence, template, sqrt(sum(w * w)) AS n FROM b GROUP BY 1, 2),
    dots AS (SELECT notice, licence, template, sum(a.w * b.w) AS dot FROM a JOIN b USING (term) GROUP BY 1, 2, 3),
    cs AS (SELECT notice, licence, max(round(dot / (na.n * nb.n), 6)) AS cosine FROM dots JOIN na USING (notice) JOIN nb USING (licence, template) GROUP BY 1, 2),
    best AS (SELECT rid, arg_min(struct_pack(l := licence, c := cosine), struct_pack(c := -cosine, l := licence)) AS x FROM f JOIN cs USING (notice) WHERE cosine >= {threshold} GROUP BY rid),
    own AS (SELECT d.*, x.l AS licence, x.c AS cosine FROM d LEFT JOIN best USING (rid)),
    speaks AS (SELECT dir, arg_min(licence, struct_pack(p := path, l := licence)) AS licence FROM own WHERE licence IS NOT NULL GROUP BY dir)
    SELECT doc_id, path, coalesce(own.licence, speaks.licence) AS licence, cosine,
           CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN speaks.licence IS NOT NULL THEN 'inherited' END AS how,
           CASE WHEN own.licence IS NULL THEN speaks.dir END AS from_dir
    FROM own LEFT JOIN speaks ON speaks.dir = own.dir"""
