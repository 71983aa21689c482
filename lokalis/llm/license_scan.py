"""License scans by a trained paragraph classifier (operator 2); DataFrame functions only on the main path.

Lines are taken without comment leaders. A paragraph is a run of lines that each hold a word of the licence
vocabulary, so that notices wrapped over lines are seen whole; each line of it is scored by itself too. The features are a
paragraph's distinct word n-grams (1 to 3 words, at least one of them no function word) that occur in the training
texts. One logistic regression for each licence family and one for "any licence" are fitted in numpy from the
templates below, variants of them and counter-examples; no corpus rows are learnt. Their weights, a bounded table,
are joined to the n-grams. A paragraph that is a licence by its probability, but no family's
probability reaches ``KNOWN``, is ``unknown``; the probability is calibrated on variants that the fit
did not see. The predicted family's templates then confirm: ``containment`` is the largest share of a
template's trigrams that the paragraph holds (of a template's words, if it has fewer than three); a family whose templates hardly occur is refuted, and the paragraph is ``unknown`` if it is a licence at all.

A wrapped notice that is confirmed as a whole is one row (``n_lines`` over 1); otherwise its lines are rows by themselves.
Texts that are null, empty or without words give no rows. Repeated rows give one row for each
paragraph; different texts of one id are scanned apart. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labelled import platt

#: How licence notices are worded, by family. All are short public notices or the openings of public licences.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
GNU_TERMS = "as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
GNU_COPY = "You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "The MIT License (MIT)",
        MIT_GRANT,
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        AS_IS,
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + GNU_TERMS.format(3),
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        GNU_WARRANTY.format(""),
        GNU_COPY.format(""),
        "Distributed under the terms of the GPL version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + GNU_TERMS.format(2.1),
        GNU_WARRANTY.format("Lesser ").replace("program", "library"),
        GNU_COPY.format("Lesser ").replace("program", "library"),
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + GNU_TERMS.format(3),
        GNU_WARRANTY.format("Affero "),
        "Distributed under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 the company. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Licence notices of no family above: what "any licence" learns besides.
OTHER_LICENCES = [
    "Licensed under the terms of the agreement in the accompanying licence file.",
    "This document may be redistributed under the licence of its owner.",
    "Distributed under a permissive license, see the license text.",
    "Use is subject to license terms.",
]
#: Counter-examples that share words with notices.
NO_LICENCES = [
    "The driver lost his license after the second accident.", "She waved to the public from the general's car.", "The foundation published a free version of the work.",
    "Students permitted themselves a source of common attribution.", "The software project has the following conditions of use in the file.", "A copy of the document was released to the press under pressure.",
    "The Apache helicopter landed near the creative school at MIT.", "They reserved the right to modify the terms of the programme.", "Version 2 of the international report was distributed later.",
    "Er kam mit dem Zug und ging mit ihr nach Hause.", "Mit der Zeit wurde alles besser, mit oder ohne Geld.", "Wir fahren mit Freunden in die Stadt und kommen mit dem Wagen an.", "Das Kind spielt mit dem Ball, die Mutter spricht mit dem Arzt.",
    "Mit ihm war es nicht schwer.", "Vienen a la casa por la tarde y van a pie.", "Il marche dans la ville et par la porte pour la nuit.", "No one of them was free to leave by any means.", "The law of the land may extend to a copy of the notice.", "She has waived her right and the author published the work to the world.",
]
#: Function words, which are no features by themselves.
FUNCTION_WORDS = "a an and any are as at be been but by can for from had has have he her his if in is it its may no not of on or she that the their them they this to under was were which will with you your"

KNOWN = 0.6
LICENCE = 0.5
CONFIRMED = 0.6
#: A family whose templates are contained less than this is not taken for the paragraph's.
BORNE_OUT = 0.3
WORD = re.compile(r"[a-z0-9]+")
GRAMS = (1, 2, 3)
NEITHER = frozenset(FUNCTION_WORDS.split())


def grams(words: list[str], sizes=GRAMS) -> set[str]:
    out = set()
    for n in sizes:
        for i in range(len(words) - n + 1):
            if any(w not in NEITHER for w in words[i : i + n]):
                out.add(" ".join(words[i : i + n]))
    return out


def training_set(seed: int = 5, variants: int = 12) -> list[tuple[str, list[str], bool]]:
    """(family, '' none or '?' other; words; held for calibration): templates, and copies with words lost or put in."""
    r = np.random.default_rng(seed)
    filler = sorted({w for t in NO_LICENCES for w in WORD.findall(t.lower())})
    texts = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [("?", t) for t in OTHER_LICENCES] + [("", t) for t in NO_LICENCES]
    out = []
    for family, text in texts:
        words = WORD.findall(text.lower())
        out.append((family, words, False))
        for k in range(variants):
            kept = [w for w in words if r.random() > 0.1]
            at = sorted(r.integers(0, len(kept) + 1, int(r.integers(0, 4))).tolist(), reverse=True)
            for i in at:
                kept.insert(i, filler[int(r.integers(len(filler)))])
            out.append((family, kept, k % 5 == 4))
    for _ in range(600):
        out.append(("", [filler[int(i)] for i in r.integers(0, len(filler), int(r.integers(3, 30)))], bool(r.random() < 0.2)))
    return out


class LicenceModel:
    """``names``: families with '' for "any licence" at the end; ``weights`` (feature, name), ``bias``, ``slope`` and ``offset`` by name."""

    def __init__(self, features: list[str], names: list[str], weights: np.ndarray, bias: np.ndarray, slope: np.ndarray, offset: np.ndarray):
        self.features, self.names, self.weights, self.bias, self.slope, self.offset = features, names, weights, bias, slope, offset


def fit(steps: int = 300, rate: float = 0.05, ridge: float = 2e-4) -> LicenceModel:
    rows = training_set()
    features = sorted(set().union(*(grams(WORD.findall(t.lower())) for t in [*itertools.chain(*TEMPLATES.values()), *OTHER_LICENCES])))
    place = {f: k for k, f in enumerate(features)}
    X = np.zeros((len(rows), len(features)), np.float32)
    for k, (_, w, _) in enumerate(rows):
        X[k, [place[g] for g in grams(w) if g in place]] = 1
    families = list(TEMPLATES)
    Y = np.array([[f == g for g in families] + [f != ""] for f, _, _ in rows], float)
    held = np.array([h for *_, h in rows])
    share = Y[~held].mean(0)
    scale = np.where(Y > 0, 0.5 / share, 0.5 / (1 - share)) / (~held).sum()
    scale[held] = 0
    W, b = np.zeros((len(features), Y.shape[1]), np.float32), np.full(Y.shape[1], -1.0, np.float32)
    m, v, mb, vb = np.zeros_like(W), np.zeros_like(W), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = (scale * (1 / (1 + np.exp(-np.clip(X @ W + b, -30, 30))) - Y)).astype(np.float32)
        gW, gb = X.T @ g + ridge * W, g.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * gW, 0.999 * v + 0.001 * gW**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        W -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    Z = (X @ W + b).astype(float)
    cal = [platt(Z[held, k], Y[held, k], np.ones(held.sum())) for k in range(Y.shape[1])]
    slope, offset = np.array(cal).T
    return LicenceModel(features, [*families, ""], W, b, slope, offset)


#: Words of a piece of a long paragraph, and those that it shares with the next one: more than any template has.
LONGEST, OVERLAP = 2000, 200
#: What comments put before a line.
LEADER = r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|\"\"\"|rem\s)\s*"


def line_words(line: Column) -> Column:
    """A line's words, lower case, in a row."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), LEADER, ""), r"[^\p{L}\p{N}]+", " "))


def paragraphs(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, text_key, block, paragraph, n_lines, words``: runs of lines with a word of the vocabulary, as wholes and, where they have several lines, line by line; no shuffle and no group but a text's own. Paragraphs of more than LONGEST words come in pieces that overlap."""
    marked = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(":"), line_words(x)))
    known = F.array(*map(F.lit, vocabulary))
    marked = F.transform(marked, lambda x: F.when(F.arrays_overlap(F.split(F.substring_index(x, ":", -1), " "), known), x).otherwise(F.lit("")))
    runs = F.filter(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda r: r != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.explode(runs).alias("run"))
    rows = rows.select("doc_id", "text_key", F.filter(F.split("run", "\n"), lambda x: x != "").alias("lines"))
    place = lambda x: F.substring_index(x, ":", 1).cast("int")
    text = lambda x: F.split(F.substring_index(x, ":", -1), " ")
    whole = F.struct(place(F.col("lines")[0]).alias("paragraph"), F.size("lines").alias("n_lines"), F.flatten(F.transform("lines", text)).alias("words"))
    single = F.transform("lines", lambda x: F.struct(place(x).alias("paragraph"), F.lit(1).alias("n_lines"), text(x).alias("words")))
    units = F.when(F.size("lines") > 1, F.concat(F.array(whole), single)).otherwise(single)
    rows = rows.select("doc_id", "text_key", place(F.col("lines")[0]).alias("block"), F.inline(units))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - OVERLAP, F.lit(1)), F.lit(LONGEST - OVERLAP)), lambda i: F.slice("words", i, LONGEST))
    return rows.withColumn("words", F.explode(F.when(F.size("words") > LONGEST, pieces).otherwise(F.array("words"))))


def paragraph_grams(words: Column, sizes=GRAMS) -> Column:
    def of(n: int) -> Column:
        out = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, out).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def template_grams(text: str) -> set[str]:
    """A template's trigrams, or its words if it has fewer than three."""
    words = WORD.findall(text.lower())
    return grams(words, (3,)) if len(words) > 2 else set(words)


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """``doc_id, paragraph, n_lines, family, probability, licence_probability, template, containment, confirmed`` of each paragraph that is a licence notice."""
    spark, model = docs.sparkSession, model or fit()
    single = [f for f in model.features if " " not in f]
    # the two tables are as large as the templates, whatever the data
    weights = spark.createDataFrame([(f, [float(x) for x in w]) for f, w in zip(model.features, model.weights)], "gram string, w array<double>")
    held = [(f"{f}#{k}", g) for f, ts in TEMPLATES.items() for k, t in enumerate(ts) for g in template_grams(t)]
    sizes: dict[str, int] = {}
    for name, _ in held:
        sizes[name] = sizes.get(name, 0) + 1
    templates = spark.createDataFrame([(n, g, 1.0 / sizes[n]) for n, g in held], "template string, gram string, part double")

    # every feature of more than one word holds a single-word feature: a line without one scores as an empty line
    key = ["doc_id", "text_key", "block", "paragraph", "n_lines", "words"]
    units = paragraphs(docs, single).distinct()
    found = units.select(*key, F.explode(paragraph_grams(F.col("words"))).alias("gram"))
    total = found.join(F.broadcast(weights), "gram").groupBy(*key).agg(*(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(model.names))))
    chance = [1 / (1 + F.exp(-(F.lit(float(s)) * (F.col(f"z{k}") + float(b)) + float(o)))) for k, (b, s, o) in enumerate(zip(model.bias, model.slope, model.offset))]
    best = F.array_max(F.array(*(F.struct(c.alias("p"), F.lit(n).alias("name")) for c, n in zip(chance[:-1], model.names))))
    total = total.select(*key, best.alias("best"), chance[-1].alias("licence_probability"))
    total = total.withColumn("probability", F.col("best.p")).withColumn("family", F.when(F.col("best.p") >= KNOWN, F.col("best.name")).otherwise("unknown"))
    total = total.filter((F.col("licence_probability") >= LICENCE) | (F.col("family") != "unknown"))
    like = total.select(*key, "family", F.explode(paragraph_grams(F.col("words"), (1, 3))).alias("gram")).join(F.broadcast(templates), "gram")
    like = like.filter(F.substring_index("template", "#", 1) == F.col("family")).groupBy(*key, "template").agg(F.sum("part").alias("containment"))
    like = like.groupBy(*key).agg(F.max(F.struct("containment", "template")).alias("like"))
    like = like.select(*(F.col(k).alias(f"like_{k}") for k in key), "like")
    same = [F.col(k).eqNullSafe(F.col(f"like_{k}")) for k in key]
    out = total.join(like, reduce(Column.__and__, same), "left")
    out = out.select(*key, "family", "probability", "licence_probability", F.col("like.template").alias("template"), F.coalesce("like.containment", F.lit(0.0)).alias("containment"))
    out = out.withColumn("family", F.when(F.col("containment") >= BORNE_OUT, F.col("family")).otherwise("unknown")).filter((F.col("licence_probability") >= LICENCE) | (F.col("family") != "unknown"))
    out = out.withColumn("confirmed", F.col("containment") >= CONFIRMED)
    # of several pieces of a paragraph, the one that is most like a template stands for all
    shown = ["confirmed", "containment", "probability", "licence_probability", "family", "template"]
    out = out.groupBy("doc_id", "text_key", "block", "paragraph", "n_lines").agg(F.max(F.struct(*shown)).alias("o")).select("doc_id", "text_key", "block", "paragraph", "n_lines", "o.*")
    # of a run of several lines: the whole if only it is confirmed, or if no line of it is a notice by itself
    run = Window.partitionBy("doc_id", "text_key", "block")
    line = F.col("n_lines") == 1
    by_line, whole = F.max((line & F.col("confirmed")).cast("int")).over(run) == 1, F.max((~line & F.col("confirmed")).cast("int")).over(run) == 1
    any_line = F.max(line.cast("int")).over(run) == 1
    as_whole = (whole & ~by_line) | ~any_line
    out = out.withColumn("shown", F.when(line, ~as_whole).otherwise(as_whole)).filter("shown")
    return out.select("doc_id", "paragraph", "n_lines", "family", "probability", "licence_probability", "template", "containment", "confirmed")
