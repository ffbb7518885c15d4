"""Licence scan: TF-IDF cosine to templates, then inheritance along directories.

Terms are lower-cased runs of ASCII letters and digits. A term's weight is
ln((1 + N) / (1 + df)) + 1 with its document frequency over all documents, which is
counted for every term of the corpus.

Compared with the templates are, as headers, every line of a text and every
paragraph (adjacent lines that hold terms, so that a wrapped notice is met whole),
and, as a licence file, the text as a whole; its first OPENING terms are compared
with the openings of licences too long to be templates. Scores are rounded to 6
places, the best wins, ties go to the smaller licence name. A document whose best
line or paragraph reaches THRESHOLD has that licence itself. One that reaches it as
a whole or by its opening is a licence file and licenses its directory; of several
the best score, then the smallest path, counts. Documents without a licence of their
own take that of the nearest directory above them that has one, found by joining
distinct directories with their ancestors.

A task holds the templates and the weights of their terms only. It keeps the parts
of a text that would reach the threshold if their other terms had the least weight
there is; the other terms of those few parts are then joined to their frequencies.

Null or empty texts have no own licence. A null path neither inherits nor licenses
others. Repeated rows are scored alike and all kept. Paths are cut at '/'; the
root directory is ''. Templates are a parameter: a bounded list, held by each task.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import map_texts, scratch, table

THRESHOLD = 0.6
OPENING = 40
# The texts of short licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. """
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# Licence identifiers with the notices that name them, and the short texts.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "MIT License. Copyright (c). " + _MIT),
    ("BSD-2-Clause", "BSD 2-Clause License. Copyright (c). All rights reserved. " + _BSD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License. Copyright (c). All rights reserved. " + _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", "ISC License. Copyright (c). " + _ISC),
]
# How the texts of long licences begin.
OPENINGS = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
]
_TERM = re.compile(r"[A-Za-z0-9]+")


def terms(text: str) -> list[str]:
    return [t.lower() for t in _TERM.findall(text)]


class Scorer:
    """Templates as unit vectors, by the document frequencies of their terms."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], n: int, least: float):
        words = [(name, terms(text)) for name, text in templates]
        self.weight = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, ts in words for t in ts}
        self.names, self.least = [name for name, _ in words], least - 1e-6
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.telling = set()  # one of these is in every text that reaches ``least``
        for k, (_, ts) in enumerate(words):
            vector = {t: c * self.weight[t] for t, c in Counter(ts).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            for t, v in vector.items():
                self.by_term.setdefault(t, []).append((k, v / norm))
            rest = 1.0
            for t, v in sorted(vector.items(), key=lambda p: -p[1]):
                if rest < self.least**2:
                    break
                self.telling.add(t)
                rest -= (v / norm) ** 2

    def candidate(self, words: list[str]) -> tuple | None:
        """(squared length of the template terms, [(licence, product)], other terms with
        their counts) where a template may reach ``least``: other terms weigh 1 or more."""
        if self.telling.isdisjoint(words):
            return None
        inside, others, product = 0.0, {}, {}
        for t, c in Counter(words).items():
            if t not in self.weight:
                others[t] = c
                continue
            x = c * self.weight[t]
            inside += x * x
            for k, v in self.by_term[t]:
                product[k] = product.get(k, 0.0) + x * v
        bound = self.least * math.sqrt(inside + sum(c * c for c in others.values()))
        near = [(self.names[k], p) for k, p in product.items() if p >= bound]
        return (inside, near, list(others.items())) if near else None


def frequencies(docs: DataFrame) -> DataFrame:
    """term, df: in how many rows of ``docs`` each term is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    held = F.array_distinct(F.split(F.translate("text", upper, upper.lower()), "[^a-z0-9]+"))
    return docs.select(F.explode(held).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def _parts(lines: list[list[str]]) -> list[tuple[bool, list[str]]]:
    """(is it the whole, terms): every line, every paragraph of several lines, the whole."""
    out, paragraph = [], []
    for words in [*lines, []]:
        if words:
            paragraph.append(words)
            out.append((False, words))
        else:
            if len(paragraph) > 1:
                out.append((False, [t for p in paragraph for t in p]))
            paragraph = []
    return [*out, (True, [t for words in lines for t in words])]


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
                 openings: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, path, header, header_score, file, file_score for each row of ``files``
    (doc_id, path, text); nulls and 0 below the threshold."""
    templates = TEMPLATES if templates is None else templates
    openings = [(name, " ".join(terms(text)[:OPENING])) for name, text in (OPENINGS if openings is None else openings)]
    df, n = scratch(frequencies(files), "frequencies"), files.count()
    vocabulary = sorted({t for _, text in templates + openings for t in terms(text)})
    counts = dict(df.where(F.col("term").isin(vocabulary)).collect())  # at most one row a template term
    whole, opening = Scorer(templates, counts, n, threshold), Scorer(openings, counts, n, threshold)

    def one(doc_id, path, text, row):
        lines = [terms(line) for line in (text or "").split("\n")]
        parts = _parts(lines)
        flat = parts[-1][1]
        found = []
        if not whole.telling.isdisjoint(flat):
            found = [(i, is_whole, *c) for i, (is_whole, words) in enumerate(parts) if (c := whole.candidate(words))]
        if c := opening.candidate(flat[:OPENING]):
            found.append((-1, True, *c))
        return doc_id, path, row, found

    id_type = files.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, path string, row bigint, parts array<struct<part:int,whole:boolean,inside:double,"
              "near:array<struct<name:string,product:double>>,others:array<struct<term:string,n:int>>>>")
    numbered = files.withColumn("_row", F.monotonically_increasing_id())
    rows = scratch(map_texts(numbered, schema, one, "doc_id", "path", "text", "_row"), "parts")
    parts = rows.select("row", F.inline("parts"))
    weight = F.log((1 + F.lit(n).cast("double")) / (1 + F.col("df"))) + 1
    # the df of every term is at hand, as the terms come from the same rows
    others = (parts.select("row", "part", F.inline("others")).join(df, "term").groupBy("row", "part")
              .agg(F.sum(F.pow(F.col("n") * weight, 2)).alias("outside")))
    scores = (parts.drop("others").join(others, ["row", "part"], "left")
              .withColumn("norm", F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0))))
              .select("row", "whole", "norm", F.inline("near"))
              .select("row", "whole", F.struct((-F.round(F.col("product") / F.col("norm"), 6)).alias("less"), "name").alias("s"))
              .where(-F.col("s.less") >= threshold))
    best = scores.groupBy("row").agg(F.min(F.when(~F.col("whole"), F.col("s"))).alias("h"), F.min(F.when(F.col("whole"), F.col("s"))).alias("f"))
    return rows.select("doc_id", "path", "row").join(best, "row", "left").select(
        "doc_id", "path", F.col("h.name").alias("header"), F.coalesce(-F.col("h.less"), F.lit(0.0)).alias("header_score"),
        F.col("f.name").alias("file"), F.coalesce(-F.col("f.less"), F.lit(0.0)).alias("file_score"))


def _directory(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(own: DataFrame) -> DataFrame:
    """doc_id, path, license, score, via ('file', 'header', 'inherited' or 'none') and
    from_path (the licence file inherited from) for each row of ``own_licenses``."""
    here = scratch(own.withColumn("directory", _directory(F.col("path"))), "licenses")
    order = Window.partitionBy("directory").orderBy(F.desc("file_score"), "path")
    # one licence file a directory; ranked after a filter that keeps few rows
    governed = (here.where(F.col("file").isNotNull() & F.col("path").isNotNull())
                .withColumn("n", F.row_number().over(order)).where("n = 1")
                .select(F.col("directory").alias("above"), "file", "file_score", F.col("path").alias("from_path")))
    parts = F.split("directory", "/")
    ancestors = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    above = here.where(F.col("directory").isNotNull()).select("directory").distinct().select(
        "directory", F.posexplode(ancestors).alias("depth", "above"))
    # written, so that a directory that holds most rows can be split or its licence broadcast
    nearest = scratch(above.join(governed, "above").groupBy("directory").agg(
        F.max_by(F.struct("file", "file_score", "from_path"), "depth").alias("up")), "nearest")
    met = here.join(nearest, "directory", "left")
    pick = lambda file, header, up, none: (F.when(F.col("file").isNotNull(), file).when(F.col("header").isNotNull(), header)
                                           .when(F.col("up").isNotNull(), up).otherwise(none))
    return met.select(
        "doc_id", "path", pick(F.col("file"), F.col("header"), F.col("up.file"), F.lit(None)).alias("license"),
        pick(F.col("file_score"), F.col("header_score"), F.col("up.file_score"), F.lit(0.0)).alias("score"),
        pick(F.lit("file"), F.lit("header"), F.lit("inherited"), F.lit("none")).alias("via"),
        F.when(F.col("file").isNull() & F.col("header").isNull(), F.col("up.from_path")).alias("from_path"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return inherit(own_licenses(files))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Terms, weights and cosines over exploded rows; directories are joined by prefix.
# Parts: lines by their number, paragraphs by the negative number of their first line, the whole as 0, the opening as 0 too.
ORACLE_SQL = f"""
WITH tpl(k, name, text) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
opn(k, name, text) AS (VALUES {", ".join(f"({len(TEMPLATES) + i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(OPENINGS))}),
tt AS (
  SELECT k, name, false AS opening, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS t FROM tpl
  UNION ALL SELECT k, name, true, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+')[:{OPENING}])) FROM opn
), lines AS (
  SELECT doc_id, u.no, u.line FROM documents, LATERAL (
    SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no) u
), held AS (
  SELECT doc_id, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run, regexp_extract_all(line, '[A-Za-z0-9]+') AS ts
  FROM lines WHERE regexp_matches(line, '[A-Za-z0-9]')
), numbered AS (
  SELECT doc_id, no, ts, min(no) OVER p AS first, count(*) OVER p AS size FROM held WINDOW p AS (PARTITION BY doc_id, run)
), lt AS (
  SELECT doc_id, no, first, size, lower(unnest(ts)) AS t FROM numbered
), df AS (
  SELECT t, count(DISTINCT doc_id) AS df FROM lt GROUP BY t
), w AS (
  SELECT coalesce(v.t, df.t) AS t, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + coalesce(df.df, 0))) + 1 AS w
  FROM (SELECT DISTINCT t FROM tt) v FULL JOIN df ON df.t = v.t
), tv AS (
  SELECT k, name, opening, tt.t, count(*) * any_value(w.w) AS x FROM tt JOIN w ON w.t = tt.t GROUP BY ALL
), tn AS (
  SELECT k, sqrt(sum(x * x)) AS norm FROM tv GROUP BY k
), head AS (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+')[:{OPENING}])) AS t FROM documents
), seg AS (
  SELECT doc_id, no, false AS opening, t, count(*) AS c FROM lt GROUP BY ALL
  UNION ALL SELECT doc_id, -first, false, t, count(*) FROM lt WHERE size > 1 GROUP BY ALL
  UNION ALL SELECT doc_id, 0, false, t, count(*) FROM lt GROUP BY ALL
  UNION ALL SELECT doc_id, 0, true, t, count(*) FROM head GROUP BY ALL
), sv AS (
  SELECT doc_id, no, opening, seg.t, c * w.w AS x FROM seg JOIN w ON w.t = seg.t
), sn AS (
  SELECT doc_id, no, opening, sqrt(sum(x * x)) AS norm FROM sv GROUP BY ALL
), cs AS (
  SELECT sv.doc_id, sv.no, tv.k, tv.name, round(sum(sv.x * tv.x) / any_value(sn.norm) / any_value(tn.norm), 6) AS score
  FROM sv JOIN tv ON tv.t = sv.t AND tv.opening = sv.opening
  JOIN sn ON sn.doc_id = sv.doc_id AND sn.no = sv.no AND sn.opening = sv.opening JOIN tn ON tn.k = tv.k GROUP BY ALL
), best AS (
  SELECT doc_id, no = 0 AS whole, name, score FROM cs WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, no = 0 ORDER BY score DESC, name) = 1
), own AS (
  SELECT d.doc_id, concat_ws('/', source, lang, d.doc_id::VARCHAR) AS path, concat_ws('/', source, lang) AS dir,
    f.name AS file, f.score AS file_score, h.name AS header, h.score AS header_score
  FROM documents d LEFT JOIN best f ON f.doc_id = d.doc_id AND f.whole LEFT JOIN best h ON h.doc_id = d.doc_id AND NOT h.whole
), gov AS (
  SELECT dir, file, file_score, path FROM own WHERE file IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY file_score DESC, path) = 1
), near AS (
  SELECT own.doc_id, gov.* FROM own JOIN gov ON own.dir = gov.dir OR starts_with(own.dir, gov.dir || '/') OR gov.dir = ''
  QUALIFY row_number() OVER (PARTITION BY own.doc_id ORDER BY length(gov.dir) DESC) = 1
)
SELECT own.doc_id, own.path, coalesce(own.file, own.header, near.file) AS license,
  coalesce(own.file_score, own.header_score, near.file_score, 0.0) AS score,
  CASE WHEN own.file IS NOT NULL THEN 'file' WHEN own.header IS NOT NULL THEN 'header'
       WHEN near.file IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
  CASE WHEN own.file IS NULL AND own.header IS NULL THEN near.path END AS from_path
FROM own LEFT JOIN near ON near.doc_id = own.doc_id
"""
