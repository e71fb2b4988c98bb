"""Operator 4, license scans, by DataFrame functions alone.

Lines of a text, and texts as a whole, are compared with license templates by the cosine of their sparse TF-IDF vectors.
A line that reaches `threshold` is a header and licenses its document; a text that does so as a whole is a license file
and licenses its directory. A document without a header takes the license of its nearest ancestor directory that has
one, by joins of paths.

Document frequencies of the templates' terms are counted over all documents; terms outside the templates weigh as much
as a term that no document has. Only texts with an anchor term are looked at closer: anchors are chosen so that the other
terms of each template together can't reach the threshold, by the Cauchy-Schwarz inequality, so nothing is lost.

Null texts count as empty. Ties go to the license first in the alphabet, among license files to the least path. Repeated
rows give repeated results, an empty table gives none. Null ids stay null; null paths inherit nothing. Other columns are
not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinward.llm.common import cut

#: (license, text) of headers and of the first lines of license files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
)

#: (license, text) of whole license files, for whole texts only; their terms' weights are apart from those above.
FILE_TEMPLATES = (
    ("MIT", """MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """BSD 3-Clause License Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


@dataclass(frozen=True)
class LicenseModel:
    idf: dict[str, float]
    unseen: float
    templates: tuple[tuple[str, str], ...]
    threshold: float
    files: LicenseModel | None = None  # for whole texts only

    def vector(self, text: str) -> dict[str, float]:
        words = _words(text)
        raw = {w: words.count(w) * self.idf[w] for w in set(words)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    def anchors(self) -> list[str]:
        """Terms of which a text must have one to reach the threshold with any template."""
        vectors = [self.vector(t) for _, t in self.templates]
        left = [0.0] * len(vectors)
        out = []
        for w in sorted(self.idf, key=lambda w: (self.idf[w], w)):
            more = [a + v.get(w, 0.0) ** 2 for a, v in zip(left, vectors, strict=True)]
            if max(more) < (self.threshold - 1e-6) ** 2:
                left = more
            else:
                out.append(w)
        return out


def fit_licenses(docs: DataFrame, *, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, file_templates: tuple[tuple[str, str], ...] = FILE_TEMPLATES, threshold: float = 0.6) -> LicenseModel:
    """Document frequencies of the templates' terms, over all of docs; a row for each term comes to the driver."""
    own, of_files = ({w for _, t in ts for w in _words(t)} for ts in (templates, file_templates))
    vocabulary = sorted(own | of_files)
    terms = F.array_intersect(F.split(F.lower(F.col(f"`{text_col}`")), "[^a-z0-9]+"), F.split(F.lit(" ".join(vocabulary)), " "))
    found = docs.select(F.explode(terms).alias("term")).groupBy("term").count().collect()
    n, df = docs.count(), {r.term: r["count"] for r in found}
    weight = lambda k: math.log((n + 1) / (k + 1)) + 1
    files = LicenseModel({w: weight(df.get(w, 0)) for w in sorted(of_files)}, weight(0), file_templates, threshold) if file_templates else None
    return LicenseModel({w: weight(df.get(w, 0)) for w in sorted(own)}, weight(0), templates, threshold, files)


def license_matches(docs: DataFrame, model: LicenseModel, *, text_col: str = "text", by_line: bool = True) -> DataFrame:
    """(key, unit, license, score): the best template of each line (unit from 0) and whole text (unit -1) that reach the threshold.

    Without `by_line`, whole texts only. key is a hash of the text: rows of equal text are looked at once.
    """
    spark = docs.sparkSession
    anchor = rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, model.anchors()))})(?![a-z0-9])"
    text = F.col(f"`{text_col}`")
    some = docs.where(F.lower(text).rlike(anchor)).select(F.xxhash64(text).alias("key"), text.alias("text")).dropDuplicates(["key"])
    lines = some.select("key", F.posexplode(F.split("text", "\n")).alias("unit", "unit_text")).where(F.lower("unit_text").rlike(anchor))
    whole = some.select("key", F.lit(-1).alias("unit"), F.col("text").alias("unit_text"))
    units = lines.unionByName(whole) if by_line else whole
    counts = units.select("key", "unit", F.explode(words_of(F.col("unit_text"))).alias("term")).groupBy("key", "unit", "term").agg(F.count("*").alias("tf"))
    idf = spark.createDataFrame(list(model.idf.items()), "term string, idf double")  # as many rows as the templates have terms
    weights = spark.createDataFrame([(i, lic, w, x) for i, (lic, t) in enumerate(model.templates) for w, x in model.vector(t).items()], "template int, license string, term string, weight double")
    weighed = counts.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(model.unseen)))
    norms = weighed.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.where("idf IS NOT NULL").join(F.broadcast(weights), "term").groupBy("key", "unit", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["key", "unit"]).select("key", "unit", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= model.threshold)
    first = F.struct(-F.col("score"), F.col("license"))
    return scores.groupBy("key", "unit").agg(F.min_by("license", first).alias("license"), F.max("score").alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path; that of a name without a slash is the empty one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(docs: DataFrame, model: LicenseModel, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", salts: int = 16) -> DataFrame:
    """(id, path, license, score, how, origin): how is header, file or inherited; origin is the directory inherited from."""
    matches = license_matches(docs, model, text_col=text_col)
    if model.files:
        matches = matches.unionByName(license_matches(docs, model.files, text_col=text_col, by_line=False))
    matches = cut(matches, "licenses")
    best = F.struct(-F.col("score"), F.col("license"))
    headers = matches.where("unit >= 0").groupBy("key").agg(F.min_by("license", best).alias("header"), F.max("score").alias("header_score"))
    files = matches.where("unit = -1").groupBy("key").agg(F.min_by("license", best).alias("file"), F.max("score").alias("file_score"))
    by_text = headers.join(files, "key", "full")
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{path_col}`").alias("path"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    rows = rows.join(by_text, "key", "left").withColumn("dir", parent(F.col("path")))

    licensed = rows.where("file IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min_by("file", F.struct(-F.col("file_score"), F.col("file"), F.col("path"))).alias("of_dir"))
    dirs = rows.where("dir IS NOT NULL").select("dir").distinct()
    names = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.size(names))
    ancestors = dirs.select(F.col("dir").alias("own"), F.explode(F.transform(depths, lambda k: F.struct(k.alias("depth"), F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(names, F.lit(1), k), "/")).alias("dir")))).alias("a")).select("own", "a.depth", "a.dir")
    nearest = ancestors.join(licensed, "dir").groupBy("own").agg(F.max_by("of_dir", "depth").alias("inherited"), F.max_by("dir", "depth").alias("origin"))
    # a directory may hold a large part of all documents: its rows are spread over `salts` keys
    spread = nearest.select("own", "inherited", "origin", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(id_col, "key"), F.lit(salts)).cast("int"))
    out = rows.join(spread, (rows["dir"] == spread["own"]) & (rows["salt"] == spread["salt"]), "left")
    own = F.coalesce("header", "file")
    return out.select(
        id_col,
        "path",
        F.coalesce(own, F.col("inherited")).alias("license"),
        F.coalesce("header_score", "file_score").alias("score"),
        F.when(F.col("header").isNotNull(), "header").when(F.col("file").isNotNull(), "file").when(F.col("inherited").isNotNull(), "inherited").alias("how"),
        F.when(own.isNull(), F.col("origin")).alias("origin"),
    )
