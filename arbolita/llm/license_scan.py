"""Licence detection: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Words are compared in lower case without separators. A term's document frequency is counted over all files. Blocks of a
file are its lines and its runs of licence-like lines (at least half of the words occur in some template); a block's
vector is term count x idf, and the licence of the template of highest cosine is the block's if the cosine reaches
``least_cosine``. A block can only reach it if it has one of the template's anchors: its heaviest terms, taken until the
rest of the template's vector is shorter than ``least_cosine``, and if it still reaches it where words of no template weigh
least (as if every file held them). Only the words of such blocks are counted besides those of the templates, over all
files, and their frequencies joined back to the blocks; none that counts is missed.

A file's own licence is that of its best block. It is a licence file, and speaks for its directory and those below, if its
name says so or that block has at least half of its words. A file without a licence of its own has that of the nearest
directory on its path, found by joining the ancestors of every distinct directory to the licensed directories; of several
licence files in one directory the best cosine counts.

Defined results: cosines are rounded to nine places; a null or empty text has no licence of its own; a null path has directory null and inherits nothing; ties of
the cosine go to the licence id first in order, then the block that begins first; repeated rows are judged alike; an empty
table gives no rows; only the named columns are read; ids keep their type. Templates are a list or a table (licence, text) of at
most ``MOST_TEMPLATES`` rows, more are an error; rows of it with a null are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolita.llm.batches import id_type, slices
from arbolita.llm.wu_manber import normal
from arbolita.session import cut

TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Copyright All rights reserved. Confidential and proprietary"),
]
LICENCE_FILE = re.compile(r"(?i)^(?:un)?(?:licen[cs]es?|copying|copyright|notice)(?:[.\-_].*)?$")
LEAST_COSINE = 0.7
#: So many words of candidate blocks go to every task that counts; beyond it all words are counted and shuffled.
KNOWN_WORDS = 200_000
_FLUSH = 200_000
MOST_TEMPLATES = 10_000


class Templates:
    """Vectors of the templates under document frequencies of their terms."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[bytes, int], files: int, least: float):
        self.least = least
        self.files = files
        self.idf = {w: self.weight(n) for w, n in df.items()}
        self.vectors: list[tuple[str, dict[bytes, float]]] = []
        self.anchors: set[bytes] = set()
        for name, text in sorted(templates):
            v = self.vector(normal(text).split())
            self.vectors.append((name, v))
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
                if rest < least * least:
                    break
                self.anchors.add(w)
                rest -= x * x
        self.terms = frozenset(w for _, v in self.vectors for w in v)

    def weight(self, n: int) -> float:
        return math.log((1 + self.files) / (1 + n)) + 1

    def vector(self, words: list[bytes], others: dict[bytes, int] | None = None) -> dict[bytes, float]:
        """``others`` are the frequencies of words that no template has; without it these weigh least."""
        v = {w: n * (self.idf[w] if w in self.idf else 1.0 if others is None else self.weight(others[w])) for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    def best(self, words: list[bytes], others: dict[bytes, int] | None, least: float) -> tuple[str, float] | None:
        v, found = self.vector(words, others), None
        for name, t in self.vectors:
            cosine = round(sum(x * v[w] for w, x in t.items() if w in v), 9)
            if cosine >= least and (found is None or cosine > found[1]):
                found = name, cosine
        return found

    def blocks(self, text: str | None) -> tuple[int, list[list[bytes]]]:
        """How many words the text has, and the blocks that could reach the cosine (no words are counted where there is none)."""
        if not text or self.anchors.isdisjoint(normal(text).split()):
            return 0, []
        lines = [w for w in (normal(x).split() for x in text.split("\n")) if w]
        blocks, held = [], []
        for words in [*lines, []]:
            if words and not self.anchors.isdisjoint(words):
                blocks.append(words)
            if words and 2 * sum(w in self.terms for w in words) >= len(words):
                held.append(words)
                continue
            if len(held) > 1:
                run = [w for h in held for w in h]
                if not self.anchors.isdisjoint(run):
                    blocks.append(run)
            held = []
        return sum(map(len, lines)), [b for b in blocks if self.best(b, None, self.least - 1e-6)]

    def judge(self, total: int, blocks: list[list[bytes]], others: dict[bytes, int]) -> tuple[str, float, float] | None:
        """(licence, cosine, share of the file's words) of the best block."""
        found = None
        for words in blocks:
            got = self.best(words, others, self.least)
            if got and (found is None or got[1] > found[1]):
                found = (*got, len(words) / total)
        return found


def listed(templates: list[tuple[str, str]] | DataFrame) -> list[tuple[str, str]]:
    """The templates of a table, whose first two columns are the licence and the text."""
    if isinstance(templates, DataFrame):
        rows = templates.select(*templates.columns[:2]).limit(MOST_TEMPLATES + 1).collect()
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = [(r[0], r[1]) for r in rows]
    return [(name, text) for name, text in templates if name is not None and text]


def _frequencies(files: DataFrame, terms: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many files each term occurs, and how many files there are."""
    names = sorted(terms)
    place = {w: k for k, w in enumerate(names)}

    def run(batches):
        n = np.zeros(len(names) + 1, np.int64)
        for batch in slices(batches):
            n[-1] += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    for w in place.keys() & set(normal(text).split()):
                        n[place[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["term", "n"])

    rows = files.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in rows}
    return {w: n.get(k, 0) for w, k in place.items()}, n.get(len(names), 0)


def _counted(files: DataFrame, words: DataFrame) -> DataFrame:
    """``word, n``: in how many files each of ``words`` (distinct) occurs."""
    some = words.limit(KNOWN_WORDS + 1).collect()
    known = frozenset(bytes(r.word) for r in some) if len(some) <= KNOWN_WORDS else None

    def packed(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        n = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    held = normal(text).split()
                    n.update(set(held) if known is None else known.intersection(held))
                    if len(n) > _FLUSH:
                        yield packed(n)
                        n = Counter()
        yield packed(n)

    counts = files.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts if known is not None else counts.join(words, "word", "left_semi")


def scan(
    files: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, least_cosine: float = LEAST_COSINE,
    id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
) -> DataFrame:
    """``doc_id, path, licence, how (own, inherited, none), cosine, from_dir`` of every file."""
    kind = id_type(files, id_col)
    templates = listed(templates)
    f = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    df, n = _frequencies(f, {w for _, t in templates for w in normal(t).split()})

    def look(batches):
        model, task, k = Templates(templates, df, n, least_cosine), uuid.uuid4().hex, 0
        for batch in slices(batches):
            keys, totals, found, words = [], [], [], []
            for text in batch.column(2).to_pylist():
                total, blocks = model.blocks(text)
                k += 1
                keys.append(f"{task}-{k}" if blocks else None)
                totals.append(total)
                found.append([b" ".join(b) for b in blocks])
                words.append(sorted({w for b in blocks for w in b} - model.terms))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(totals, pa.int64()), pa.array(found, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.binary()))],
                names=["doc_id", "path", "key", "total", "blocks", "words"],
            )

    def run(batches):
        model = Templates(templates, df, n, least_cosine)
        for batch in slices(batches):
            got = []
            for total, blocks, others in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                counts = {o["word"]: o["n"] for o in others or ()}
                got.append(model.judge(total, [b.split(b" ") for b in blocks], counts) or (None, None, None))
            licence, cosine, share = zip(*got) if got else ((), (), ())
            speaks = [
                x is not None and p is not None and (s >= 0.5 or LICENCE_FILE.match(p.rsplit("/", 1)[-1]) is not None)
                for x, s, p in zip(licence, share, batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(licence, pa.string()), pa.array(cosine, pa.float64()), pa.array(speaks, pa.bool_())],
                names=["doc_id", "path", "own", "own_cosine", "speaks"],
            )

    looked = cut(f.mapInArrow(look, f"doc_id {kind}, path string, key string, total long, blocks array<binary>, words array<binary>"), "blocks")
    each = looked.where("key is not null").select("key", F.explode("words").alias("word"))
    counts = _counted(f, each.select("word").distinct())
    others = each.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("others"))
    some = looked.where("key is not null").join(others, "key", "left").select("doc_id", "path", "total", "blocks", "others")
    rest = looked.where("key is null").select("doc_id", "path", "total", "blocks", F.lit(None).cast("array<struct<word: binary, n: bigint>>").alias("others"))
    own = some.unionByName(rest).mapInArrow(run, f"doc_id {kind}, path string, own string, own_cosine double, speaks boolean")
    steps = F.split("path", "/")
    own = own.withColumn("dir", F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))), "/"))
    own = cut(own, "licences")
    licensed = own.where("speaks").groupBy(F.col("dir").alias("from_dir")).agg(
        F.max(F.struct(F.col("own_cosine").alias("cosine"), F.transform(F.split("own", ""), lambda c: -F.ascii(c)).alias("down"), F.col("own").alias("licence"))).alias("best")
    )
    licensed = licensed.select("from_dir", F.col("best.licence").alias("dir_licence"), F.col("best.cosine").alias("dir_cosine"))
    dirs = own.where("own is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("from_dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    # the root is "", of depth 0; "" split gives one empty part, so its depth 1 is "" again
    near = above.join(licensed, "from_dir").groupBy(F.col("dir").alias("at")).agg(F.max_by(F.struct("dir_licence", "dir_cosine", "from_dir"), "depth").alias("near"))
    joined = own.join(near, own["own"].isNull() & (own["dir"] == near["at"]), "left")
    mine = F.col("own").isNotNull()
    return joined.select(
        "doc_id", "path",
        F.coalesce("own", "near.dir_licence").alias("licence"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("own_cosine", "near.dir_cosine").alias("cosine"),
        F.when(~mine, F.col("near.from_dir")).alias("from_dir"),
    )
