"""License scan: sparse TF-IDF cosine of passages to licence notices and texts, then inheritance
from the nearest ancestor directory by path joins.

* Document frequencies of all terms are counted over all files, in a distributed table.
* A passage is every run of a template's length in the whole text, and every line, block of
  lines without a blank one, and the whole text. Titles are held against lines and blocks only,
  as prose may name a licence; a title or an SPDX line only matches with all of its terms.
* A term weighs at least 1 and at most what one of a single file weighs. With these bounds a scan
  drops the passages that cannot reach the threshold or the best of their file, without loss; the
  weights of the few left are joined by term.
* A file with its own licence keeps it. Otherwise the licence of the nearest ancestor
  directory that holds a licence file applies: the distinct directories (not the files) are
  exploded to their ancestors and joined with the licensed directories.

Edge cases: null and empty texts have no licence of their own but can inherit; several
matches resolve to the highest score, then the smaller name; several licence files of one
directory to the highest score, then name; a path without a directory belongs to the root '';
repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Customary notices of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
#: Longer notices that their licences ask for.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
TITLES = {
    "Apache-2.0": ("Apache License", "Apache License 2.0", "Apache License Version 2.0", "Apache License Version 2.0, January 2004"),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "GPL-3.0": ("GNU General Public License Version 3", "GNU General Public License Version 3, 29 June 2007"),
    "MIT": ("MIT License", "The MIT License"),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
}
SPDX = {n: (n,) for n in ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "MIT", "MPL-2.0")} | {"GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")}
#: Full texts, one file a licence.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")
THRESHOLD = 0.7
#: Scores are compared with this much room for rounding.
EPSILON = 1e-9
_TERM = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def known_templates() -> dict[tuple[str, str], str]:
    """(licence, kind) to text; kinds are notice, header, title, spdx and text, with a number after."""
    out = {(n, "notice"): x for n, x in TEMPLATES.items()} | {(n, "header"): x for n, x in HEADERS.items()}
    out |= {(n, f"title{i}"): x for n, xs in TITLES.items() for i, x in enumerate(xs)}
    out |= {(n, f"spdx{i}"): f"SPDX-License-Identifier: {x}" for n, xs in SPDX.items() for i, x in enumerate(xs)}
    for name in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, name), encoding="utf-8") as f:
            out[name.removesuffix(".txt"), "text"] = f.read()
    return out


class Model:
    """Unit template vectors over the template vocabulary, and the greatest weight of any term in a file."""

    def __init__(self, templates: dict, df: dict[str, int], n_files: int):
        self.idf = {t: weight(n_files, df.get(t, 0)) for x in templates.values() for t in terms(x)}
        self.rare = weight(n_files, 1)
        self.vectors, self.lengths = {}, {}
        for key, text in sorted(templates.items()):
            tf = Counter(terms(text))
            weights = {t: c * self.idf[t] for t, c in tf.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors[key] = {t: w / norm for t, w in weights.items()}
            self.lengths[key] = sum(tf.values())
        self.keys = list(self.vectors)
        self.place = {t: i for i, t in enumerate(sorted(self.idf))}
        self.squares = np.zeros((len(self.place), len(self.keys)))
        for j, vector in enumerate(self.vectors.values()):
            for t, w in vector.items():
                self.squares[self.place[t], j] = w * w

    def best(self, tf: Counter, threshold: float) -> tuple | None:
        """The best template for a passage whose unknown terms all weigh the most."""
        norm = math.sqrt(sum((c * self.idf.get(t, self.rare)) ** 2 for t, c in tf.items()))
        found = None
        for name, vector in self.vectors.items():
            cosine = sum(c * self.idf[t] * vector[t] for t, c in tf.items() if t in vector) / norm if norm else 0.0
            if cosine >= threshold and (found is None or cosine > found[1] + 1e-12):
                found = (name, cosine)
        return found

    def possible(self, known: set, threshold: float) -> list:
        """Templates that a passage of these terms could reach: by Cauchy-Schwarz its cosine is at most the template's norm on them."""
        reach = self.squares[[self.place[t] for t in known]].sum(axis=0)
        return [self.keys[j] for j in np.flatnonzero(reach >= threshold**2 - EPSILON)]

    def sums(self, tf: Counter, vector: dict) -> tuple[float, float, int]:
        """Dot product, squared norm on the vocabulary, and squared counts of other terms."""
        dot = sum(c * self.idf[t] * vector[t] for t, c in tf.items() if t in vector)
        return dot, sum((c * self.idf[t]) ** 2 for t, c in tf.items() if t in self.idf), sum(c * c for t, c in tf.items() if t not in self.idf)


def weight(n_files: int, df: int) -> float:
    return math.log((1 + n_files) / (1 + df)) + 1


def kind_of(key) -> tuple[str, str]:
    return (key[0], key[1].rstrip("0123456789")) if isinstance(key, tuple) else (key, "notice")


def _windows(model: Model, all_terms: list[str], key, threshold: float):
    """(start, end) of the runs of the template's length that can reach the threshold."""
    vector, idf = model.vectors[key], model.idf
    length = min(model.lengths[key], len(all_terms))
    counts: dict[str, int] = {}
    dot = norm = 0.0
    for i, t in enumerate(all_terms):
        w = idf.get(t, 1.0)
        c = counts.get(t, 0)
        counts[t] = c + 1
        norm += (2 * c + 1) * w * w
        dot += w * vector.get(t, 0.0)
        if i >= length:
            t = all_terms[i - length]
            w = idf.get(t, 1.0)
            c = counts[t]
            counts[t] = c - 1
            norm -= (2 * c - 1) * w * w
            dot -= w * vector.get(t, 0.0)
        if i >= length - 1 and dot > 0 and dot * dot >= (threshold**2) * norm * (1 - 1e-6):
            yield i - length + 1, i + 1


def _passages(low: str) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int]]]:
    """Terms of the whole text, and the ranges of its lines and of its blocks."""
    found, lines, blocks, opened = [], [], [], 0
    for line in low.split("\n"):
        at = len(found)
        found += _TERM.findall(line)
        lines.append((at, len(found)))
        if not line.strip():
            blocks.append((opened, at))
            opened = at
    blocks.append((opened, len(found)))
    return found, [x for x in lines if x[0] < x[1]], [x for x in blocks if x[0] < x[1]]


def candidates(model: Model, text: str, threshold: float) -> list[tuple[str, float, float, bool, dict]]:
    """(licence, dot, squared norm on the vocabulary, mostly, other terms) of the passages that may be the text's best match."""
    low = text.lower()
    known = model.idf.keys() & set(_TERM.findall(low))
    keys = model.possible(known, threshold) if known else []
    if not keys:
        return []
    all_terms, lines, blocks = _passages(low)
    rows, floor = [], threshold
    for key in keys:
        name, kind = kind_of(key)
        vector = model.vectors[key]
        spans = {*lines, *blocks}
        if kind != "title":
            spans |= {(0, len(all_terms)), *_windows(model, all_terms, key, threshold)}
        for a, b in sorted(spans):
            if vector.keys().isdisjoint(all_terms[a:b]):
                continue
            tf = Counter(all_terms[a:b])
            if kind in ("title", "spdx") and not vector.keys() <= tf.keys():
                continue
            dot, norm, others = model.sums(tf, vector)
            most = dot / math.sqrt(norm + others)
            if most < threshold - EPSILON:
                continue
            floor = max(floor, dot / math.sqrt(norm + others * model.rare**2))
            rows.append((most, (name, dot, norm, 2 * (b - a) > len(all_terms), {t: c for t, c in tf.items() if t not in model.idf})))
    return [x for most, x in rows if most >= floor - EPSILON]


def choose(rows: list, idf: dict[str, float], threshold: float) -> tuple[str, float, bool] | None:
    """(licence, score, mostly) of the best candidate by the weights of the other terms; ties to the smaller name."""
    best = None
    for name, dot, norm, mostly, others in rows:
        score = min(1.0, dot / math.sqrt(norm + sum((c * idf[t]) ** 2 for t, c in others.items())))
        if score >= threshold - EPSILON and (best is None or (-round(score, 9), name, not mostly) < (-round(best[1], 9), best[0], not best[2])):
            best = (name, score, mostly)
    return best


def _document_frequency(frames):
    for pdf in frames:
        counts: Counter = Counter()
        for text in pdf["text"]:
            if text:
                counts.update(set(_TERM.findall(text.lower())))
        if counts:
            yield pd.DataFrame({"term": list(counts.keys()), "n": list(counts.values())})


FOUND = "path string, own_license string, own_score double, mostly boolean"


def _scan(model: Model, threshold: float, n_chunks: int):
    def run(frames):
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                rows = candidates(model, text, threshold) if text else []
                asked = sorted({t for x in rows for t in x[4]})
                best = None if asked else choose(rows, {}, threshold)
                chunk = zlib.crc32(f"{path}\0{text}".encode("utf-8", "replace")) % n_chunks if asked else None
                out.append((path, *(best or (None, None, False)), chunk, asked or None, json.dumps(rows) if asked else None))
            yield pd.DataFrame(out, columns=["path", "own_license", "own_score", "mostly", "chunk", "asked", "pending"]).astype({"chunk": "Int32"})

    return run


def _settle(n_files: int, threshold: float):
    def run(pending, answers):
        idf = {t: weight(n_files, n) for t, n in zip(answers["term"], answers["n"])}
        out = [(path, *(choose(json.loads(rows), idf, threshold) or (None, None, False))) for path, rows in zip(pending["path"], pending["pending"])]
        return pd.DataFrame(out, columns=["path", "own_license", "own_score", "mostly"])

    return run


def detect(files: DataFrame, templates: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """path, own_license, own_score, mostly (the match is over half of the file's terms) for each row of (path, text)."""
    templates = known_templates() if templates is None else templates
    rows = files.select("path", "text")
    counts = C.checkpoint(rows.select("text").mapInPandas(_document_frequency, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    vocabulary = sorted({t for x in templates.values() for t in terms(x)})
    wanted = files.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    df = {t: n for t, n in counts.join(F.broadcast(wanted), "term", "left_semi").collect()}  # at most the template vocabulary
    n_files, n_bytes = C.volume(rows)
    model = Model(templates, df, n_files)
    scanned = C.checkpoint(rows.mapInPandas(_scan(model, threshold, C.chunk_count(n_bytes)), FOUND + ", chunk int, asked array<string>, pending string"))
    pending = scanned.filter("chunk is not null")
    answers = pending.select(F.col("chunk").alias("to"), F.explode("asked").alias("term")).distinct().join(counts, "term")
    settled = pending.select("chunk", "path", "pending").groupBy("chunk").cogroup(answers.groupBy("to")).applyInPandas(_settle(n_files, threshold), FOUND)
    return scanned.filter("chunk is null").select("path", "own_license", "own_score", "mostly").unionByName(settled)


def directory(path):
    """Everything before the last slash; '' at the root."""
    return F.regexp_replace(F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit("")), "/+$", "")


def inherit(found: DataFrame, is_license_file) -> DataFrame:
    """Adds license and inherited_from to detect()'s rows; is_license_file is a condition on them."""
    rows = found.withColumn("dir", directory(F.coalesce("path", F.lit(""))))
    licensed = (
        rows.filter(is_license_file & F.col("own_license").isNotNull())
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("m"))
        .select(F.col("dir").alias("ancestor"), F.col("m.name").alias("dir_license"))
    )
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = rows.select("dir").distinct().select("dir", F.posexplode(F.array_distinct(ancestors)).alias("depth", "ancestor"))
    nearest = up.join(licensed, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_license"), "depth").alias("near"))
    joined = rows.join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return joined.select(*found.columns, F.coalesce("own_license", "near.dir_license").alias("license"), F.when(~own, F.col("near.ancestor")).alias("inherited_from"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, own_license, own_score, license, inherited_from.

    A document's path is source/thousand/hundred/doc_id; one that is for the most part a notice or a
    licence's text counts as a licence file of its directory, one that only holds a notice doesn't.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID))
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("none")), F.floor(ident / 1000).cast("string"), F.floor(ident / 100).cast("string"), ident.cast("string"))
    found = inherit(C.checkpoint(detect(docs.select(path.alias("path"), "text"))), F.col("mostly"))
    out = found.withColumn("doc_id", F.substring_index("path", "/", -1).cast("long"))
    return out.select(C.id_or_null(), "own_license", F.round("own_score", 6).alias("own_score"), "license", "inherited_from")
