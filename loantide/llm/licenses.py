"""License scan by sparse TF-IDF cosine with templates, and inheritance along paths; DataFrame functions only."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loantide.llm.common import broadcast_if_small, stored
from loantide.llm.decontaminate import _BREAKS, words

#: Usual short notices, grants and whole texts of well-known licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
        "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
        "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


def template_frame(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Rows (template, license, text) of a list of templates."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, license string, text string")


def _literals(terms: list[str]) -> Column:
    """One literal holding terms, which are letters and digits only."""
    return F.split(F.lit(" ".join(terms)), " ") if terms else F.array().cast("array<string>")


def _runs(needs: list[tuple[int, int, list[str]]]) -> tuple[Column, Column]:
    """The words of ``text`` with their lines, and units of its ``terms`` and ``starts``: from each line on, as many words as a template has, where enough of its terms are among them.

    ``needs`` holds (words, least number of distinct terms, terms) per template. Comment marks and lines without words
    vanish, as only words are counted. Templates whose terms the whole text lacks are left out first; starts are tested one by one,
    so a long text holds no more than the runs that pass.
    """
    word = lambda w, k, line: F.struct(w.alias("w"), k.alias("k"), line.alias("line"))
    wanted = F.array(
        *[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), _literals(terms).alias("terms")) for n, m, terms in needs]
    )
    run = lambda start, need: F.slice("terms", start["p"] + 1, need["n"])
    enough = lambda start, need: F.size(F.array_intersect(run(start, need), need["terms"])) >= need["m"]
    unit = lambda start, need: F.struct(
        F.lit(3).alias("kind"), start["line"].alias("line"), need["n"].alias("n"), F.array_join(run(start, need), " ").alias("text")
    )
    passing = lambda need: F.transform(F.filter("starts", lambda s: enough(s, need)), lambda s: unit(s, need))
    lines = F.transform(
        F.split("text", "\n"),
        lambda t, line: F.transform(F.array_remove(F.split(F.lower(t), _BREAKS), ""), lambda w, k: word(w, k, line)),
    )
    possible = F.filter(wanted, lambda need: F.size(F.array_intersect("terms", need["terms"])) >= need["m"])
    return F.flatten(lines), F.array_distinct(F.flatten(F.transform(possible, passing)))


def find_licenses(
    docs: DataFrame, templates: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.8
) -> DataFrame:
    """The best license of each document that has one: id, content, license, similarity, whole, line.

    Units are each line, each paragraph of several lines (between blank lines), the whole text, and runs of lines: from each line on
    as many words as a template has, compared with the templates of that many words, so a notice that is wrapped or commented is
    found beside code. A unit and a template are vectors of term counts times inverse document frequency over all documents; a term of no template weighs as one that no document
    holds. The unit of the greatest cosine counts, from ``least`` on; ties go to the license first in order, then to the whole
    text, a line, a paragraph, a run, and the first line. ``line`` counts from 0 and is NULL for texts and paragraphs. ``whole`` tells that the whole text is like a template: a licence file. ``content`` hashes the text; rows
    alike in id and text are one document.

    Templates are a bounded parameter: their terms and weights pass the driver. A unit without any of a template's heaviest terms
    cannot reach ``least`` (the rest of the template is too short a vector), so other units are skipped without loss; nor can a run
    that holds fewer of a template's terms than its heaviest ones that together make up the square of ``least``.
    NULL and empty texts have no license; empty tables give no rows; other columns are not read.
    """
    text = F.col(text_column).cast("string")
    terms = [
        (r.template, r.license, r.term, r["count"])
        for r in templates.select("template", "license", F.explode(words("text")).alias("term"))
        .groupBy("template", "license", "term")
        .count()
        .collect()
    ]
    vocabulary = sorted({t for _, _, t, _ in terms})
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text, F.lit(1)).alias("content"), text.alias("text"))
    held = keyed.select(F.array_intersect(words("text"), _literals(vocabulary)).alias("held"))
    # One row per template term and task: the document frequencies of the vocabulary, and their number.
    counted = {
        r.term: r.n
        for r in held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    documents = counted.get("", 0)
    unknown = math.log(documents + 1) + 1
    idf = {t: math.log((documents + 1) / (counted.get(t, 0) + 1)) + 1 for t in vocabulary}
    weights: dict[int, dict[str, float]] = defaultdict(dict)
    names = {}
    for template, name, term, n in terms:
        weights[template][term], names[template] = n * idf[term], name
    sizes: dict[int, int] = defaultdict(int)
    for template, _, _, n in terms:
        sizes[template] += n
    anchors, needs = set(), []
    for template, vector in weights.items():
        rest = whole = sum(w * w for w in vector.values())
        must = 0
        for term in sorted(vector, key=lambda t: (-vector[t], t)):
            if rest >= least**2 * whole * (1 - 1e-9):
                anchors.add(term)
            if whole - rest < least**2 * whole * (1 - 1e-9):
                must += 1
            rest -= vector[term] ** 2
        needs.append((sizes[template], must, sorted(vector)))
    spark = docs.sparkSession
    lengths = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in weights.items()}
    template_rows = [(k, names[k], sizes[k], t, w / lengths[k]) for k, v in weights.items() for t, w in v.items()]
    template_terms = spark.createDataFrame(template_rows, "template int, license string, of_n int, term string, w double")
    idf_terms = spark.createDataFrame(sorted(idf.items()), "term string, idf double")

    if not needs:
        return keyed.where("false").selectExpr(
            f"id AS `{id_column}`", "content", "'' AS license", "0D AS similarity", "false AS whole", "0 AS line"
        )
    anchored = F.arrays_overlap(words("text"), _literals(sorted(anchors)))
    flat, runs = _runs(needs)
    some = keyed.where(anchored).withColumn("flat", flat)
    places = F.transform("flat", lambda w, p: F.struct(p.alias("p"), w["k"].alias("k"), w["line"].alias("line")))
    # A plain ``flat.w`` would be folded into the tests of the starts and made anew for each.
    terms_of = F.transform("flat", lambda w: w["w"])
    some = some.select("id", "content", "text", terms_of.alias("terms"), F.filter(places, lambda w: w["k"] == 0).alias("starts"))
    kind = lambda k, line, t: F.struct(F.lit(k).alias("kind"), line.alias("line"), F.lit(0).alias("n"), t.alias("text"))
    kinds = F.concat(
        F.array(kind(0, F.lit(0), F.col("text"))),
        F.transform(F.split("text", "\n"), lambda t, i: kind(1, i, t)),
        F.filter(
            F.transform(F.split("text", r"\n\s*\n"), lambda t, i: kind(2, i, t)), lambda u: F.trim(u["text"]).contains("\n")
        ),
        runs,
    )
    units = some.select("id", "content", F.inline(kinds)).where(anchored).distinct()
    unit = ["id", "content", "kind", "line", "n"]
    counts = (
        units.select(*unit, F.explode(words("text")).alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("times"))
    )
    weighted = counts.join(F.broadcast(idf_terms), "term", "left").withColumn(
        "v", F.col("times") * F.coalesce("idf", F.lit(unknown))
    )
    norms = Window.partitionBy(*unit)
    scored = (
        weighted.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(norms)))
        .join(F.broadcast(template_terms), "term")
        .where("kind <> 3 OR n = of_n")
        .groupBy(*unit, "template", "license")
        .agg((F.sum(F.col("v") * F.col("w")) / F.first("norm")).alias("similarity"))
        .where(F.col("similarity") >= least)
    )
    order = F.struct((-F.round("similarity", 9)).alias("far"), "license", "kind", "line", "similarity")
    best = scored.groupBy("id", "content").agg(F.min(order).alias("b"), F.max(F.col("kind") == 0).alias("whole"))
    return best.select(
        F.col("id").alias(id_column), "content", "b.license", "b.similarity", "whole", F.when(F.col("b.kind").isin(1, 3), F.col("b.line")).alias("line")
    )


def license_of_paths(
    docs: DataFrame,
    templates: DataFrame,
    path_column: str = "path",
    id_column: str = "doc_id",
    text_column: str = "text",
    least: float = 0.8,
) -> DataFrame:
    """One row per document: id, path, license, similarity, origin and from_directory.

    A document's own notice goes first (``origin`` is own). Otherwise it inherits from the nearest directory
    above it, its own included, that holds a licence file (``origin`` is inherited); without one all three are NULL. Of several
    licence files in a directory the most similar counts, then the license first in order. Directories are the parts of
    the path before its last slash, down to the empty one; a NULL path has none.

    Ancestors are listed per distinct directory, not per document; documents then meet their directory's answer. Repeated rows give a
    row each and NULL ids are ids; see :func:`find_licenses` for texts. An empty table gives no rows; other columns are not read.
    """
    found = stored(find_licenses(docs, templates, id_column, text_column, least), "licenses")
    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(
        F.col("path").isNotNull(), F.lit("")
    )
    keyed = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(F.col(text_column).cast("string"), F.lit(1)).alias("content"),
        F.col(path_column).cast("string").alias("path"),
    ).withColumn("directory", directory)
    own = found.select(
        F.col(id_column).alias("own_id"), F.col("content").alias("own_content"), "license", "similarity", "whole"
    )
    marked = stored(
        keyed.join(
            broadcast_if_small(own), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content")), "left"
        ).drop("own_id", "own_content", "content"),
        "licenses",
    )
    files = marked.where("whole AND directory IS NOT NULL").groupBy("directory").agg(
        F.min(F.struct((-F.col("similarity")).alias("far"), "license", "similarity")).alias("f")
    )
    files = files.select(F.col("directory").alias("above"), F.col("f.license").alias("above_license"), F.col("f.similarity").alias("above_similarity"))
    parts = F.split("directory", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )
    directories = marked.where("license IS NULL AND directory IS NOT NULL").select("directory").distinct()
    nearest = (
        directories.select("directory", F.explode(F.array_distinct(ancestors)).alias("above"))
        .join(files, "above")
        .groupBy("directory")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "above", "above_license", "above_similarity")).alias("a"))
        .select(F.col("directory").alias("of_directory"), "a.*")
    )
    answered = marked.join(
        broadcast_if_small(stored(nearest, "directories")),
        F.col("license").isNull() & (F.col("directory") == F.col("of_directory")),
        "left",
    )
    mine = F.col("license").isNotNull()
    return answered.select(
        F.col("id").alias(id_column),
        F.col("path").alias(path_column),
        F.coalesce("license", "above_license").alias("license"),
        F.round(F.coalesce("similarity", "above_similarity"), 6).alias("similarity"),
        F.when(mine, "own").when(F.col("above_license").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("directory")).otherwise(F.col("above")).alias("from_directory"),
    )
