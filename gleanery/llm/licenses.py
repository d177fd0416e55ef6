"""License scans: TF-IDF cosine to templates, then inheritance from the nearest folder.

A file's passages are its lines, its sentences and, to be compared with whole licence
texts, its paragraphs and itself. Each different passage is compared with every
template by the cosine of sparse TF-IDF vectors; document frequencies of the templates'
terms come from all files, and any other term counts as rare. A passage can reach the
threshold only if it has one of a template's heaviest terms (those left would be too
short a vector), so that passages without any are left out beforehand; no match is
lost. The best match of at least ``threshold`` is the file's own licence. A file whose
notice makes up at least ``license_share`` of its words, or whose name is that of a
licence file, speaks for its folder; files without a licence of their own inherit from
the nearest folder above them that has one.

Edge cases: a null or empty text has no own licence; a null path lies in no folder
and inherits nothing; a folder with several licence files takes the most similar
one, then the first path; equal rows get equal results; texts and passages of any
length are read whole; an empty table gives an empty result; columns other than those
named are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import cut, small_or_merged

#: Usual notices of licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole texts of short licences, which paragraphs and whole files are compared with.
WHOLE_TEXTS = (
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) {_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) {_BSD} {_BSD_NAME} {_BSD_END}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY),
)
LICENSE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def term_column(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def document_frequencies(files: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Number of files, and for each term of the templates how many have it: as many rows as the templates have terms."""
    vocabulary = sorted({term for _, text in TEMPLATES + WHOLE_TEXTS for term in terms(text)})
    own = F.array_intersect(term_column(F.coalesce(F.col(text_col), F.lit(""))), _array(vocabulary))
    rows = files.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    counts = {row["term"]: row["count"] for row in rows}
    return counts.pop("", 0), counts


class Vectors:
    """Unit vectors of the templates under the corpus's document frequencies."""

    def __init__(self, n: int, counts: dict[str, int]):
        self.rare = math.log(1 + n) + 1
        self.idf = {term: math.log((1 + n) / (1 + count)) + 1 for term, count in counts.items()}
        self.names: list[str] = []
        self.weights: list[dict[str, float]] = []
        for name, text in TEMPLATES + WHOLE_TEXTS:
            weights = {term: tf * self.idf.get(term, self.rare) for term, tf in Counter(terms(text)).items()}
            length = math.sqrt(sum(x * x for x in weights.values()))
            self.names.append(name)
            self.weights.append({term: x / length for term, x in weights.items()})

    def heaviest(self, templates: range, threshold: float) -> list[str]:
        """Of each template the heaviest terms without any of which no passage reaches the threshold."""
        out = set()
        for k in templates:
            missing = 0.0
            for term, x in sorted(self.weights[k].items(), key=lambda item: (-item[1], item[0])):
                out.add(term)
                missing += x * x
                if missing > 1 - threshold * threshold + 1e-9:
                    break
        return sorted(out)

    def table(self, spark: SparkSession) -> DataFrame:
        """For each term of the templates: term, idf and its weight in each template."""
        known = sorted({term for weights in self.weights for term in weights})
        rows = [(term, self.idf.get(term, self.rare), [weights.get(term, 0.0) for weights in self.weights]) for term in known]
        return spark.createDataFrame(rows, "_term string, idf double, weights array<double>")


def passages(text: Column, notices: list[str], wholes: list[str]) -> Column:
    """The different passages of a text that have one of the heaviest terms."""
    bare = F.regexp_replace(text, r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|--+|;+)[ \t]*", "")
    lines = F.split(bare, r"\n+")
    sentences = F.split(F.regexp_replace(text, r"\s+(?:(?:#+|//+|\*+|--+|;+)\s+)?", " "), r"(?<=[.!?])\s")
    large = F.array_union(F.split(bare, r"\n[ \t]*\n\s*"), F.array(bare))
    has = lambda names: lambda x: F.arrays_overlap(term_column(x), _array(names))
    short = F.filter(F.array_union(lines, sentences), has(notices))
    return F.array_union(short, F.when(F.arrays_overlap(term_column(text), _array(wholes)), F.filter(large, has(wholes))).otherwise(F.array().cast("array<string>")))


def matches(found: DataFrame, vectors: Vectors) -> DataFrame:
    """For each different passage: passage, similarity (of the best template), license, n_terms."""
    table = F.broadcast(vectors.table(found.sparkSession))  # as many rows as the templates have terms
    counted = found.select("passage").distinct().select("passage", F.explode(term_column(F.col("passage"))).alias("term")).groupBy("passage", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counted.join(table, F.col("term") == F.col("_term"), "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(vectors.rare)))
    dots = [F.sum(F.col("w") * F.coalesce(F.get("weights", F.lit(k)), F.lit(0.0))).alias(f"d{k}") for k in range(len(vectors.names))]
    summed = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.sum("tf").alias("n_terms"), *dots)
    best = F.array_max(F.array(*(F.struct(F.round(F.col(f"d{k}") / F.col("length"), 6).alias("similarity"), F.lit(name).alias("license")) for k, name in enumerate(vectors.names))))
    return summed.select("passage", best.alias("best"), "n_terms").select("passage", "best.similarity", "best.license", "n_terms")


def folders(path: Column) -> Column:
    """The folders above a path, from the root (an empty name) down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan_licenses(df: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.8, license_share: float = 0.25) -> DataFrame:
    """Per row: its id, path, license, similarity (of an own one), via (own, inherited or null) and license_folder."""
    vectors = Vectors(*document_frequencies(df, text_col))
    notices, wholes = vectors.heaviest(range(len(TEMPLATES)), threshold), vectors.heaviest(range(len(TEMPLATES), len(vectors.names)), threshold)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), text.alias("_text"), term_column(text).alias("_terms"))
    asks = F.arrays_overlap("_terms", _array(sorted({*notices, *wholes})))
    # Written with a number for each row; texts stay behind, only passages with a heavy term go on.
    rows = cut(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_path", F.when(asks, F.size("_terms")).alias("_n"), F.when(asks, passages(F.col("_text"), notices, wholes)).alias("_passages")))
    asked = rows.select("_row", F.explode("_passages").alias("passage"))
    known = cut(matches(asked, vectors).where(F.col("similarity") >= threshold)).withColumnRenamed("passage", "_passage")
    found = asked.join(known.hint("merge"), F.col("passage") == F.col("_passage")).groupBy(F.col("_row").alias("_of")).agg(F.max(F.struct("similarity", "license", F.col("n_terms").alias("terms"))).alias("_m"))
    found = rows.drop("_passages").join(found, F.col("_row") == F.col("_of"), "left")
    hit = F.col("_m").isNotNull()
    speaks = hit & ((F.col("_m.terms") >= license_share * F.col("_n")) | F.col("_path").rlike(LICENSE_NAME))
    files = cut(
        found.select(
            "_id", "_path", F.element_at(folders(F.col("_path")), -1).alias("_folder"), F.col("_m.license").alias("_own"),
            F.col("_m.similarity").alias("_similarity"), F.coalesce(speaks, F.lit(False)).alias("_speaks"),
        )
    )
    # One licence a folder, then one inherited licence a folder, so that the files of a
    # folder with very many meet a single row, in a join that can be split.
    best = F.min(F.struct((-F.col("_similarity")).alias("s"), F.col("_path").alias("p"), F.col("_own").alias("license")))
    licensed = cut(files.where("_speaks").groupBy(F.col("_folder").alias("at")).agg(best["license"].alias("license")))
    asking = files.where("_own is null and _folder is not null").select("_folder", folders(F.concat("_folder", F.lit("/"))).alias("above")).distinct()
    asked = asking.select(F.col("_folder").alias("folder"), F.posexplode("above").alias("depth", "at"))
    # Every folder asks the topmost ones: written, so that their rows can be split, or sent to all.
    nearest = cut(asked.join(small_or_merged(licensed), "at").groupBy("folder").agg(F.max_by(F.struct("at", "license"), "depth").alias("from")).select("folder", "from.at", "from.license"))
    joined = files.join(nearest.hint("merge"), files["_folder"] == nearest["folder"], "left")
    inherits = F.col("_own").isNull() & F.col("license").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias("path"),
        F.coalesce("_own", "license").alias("license"),
        F.col("_similarity").alias("similarity"),
        F.when(F.col("_own").isNotNull(), "own").when(inherits, "inherited").alias("via"),
        F.when(inherits, F.col("at")).alias("license_folder"),
    )
