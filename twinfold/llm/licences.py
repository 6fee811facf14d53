"""License scans: a trained paragraph classifier, confirmed by template comparison, in DataFrame operations only.

A paragraph ends at a blank line, or where a line ends with a sign that ends a sentence; lines broken
within one belong together. Its features are the hashes of the word one- and two-grams it holds, weighted alike and scaled to
length 1. A softmax regression over them, fitted from license wording, from near-misses and from a bounded sample of
the corpus's own paragraphs (the first 2,000 letters of each) as the unknown class, gives each paragraph a probability of each
family. What it was not fitted on, whole sentences with all names put into them and half of the other paragraphs, calibrates it: a temperature, and
an offset of the unknown class so that at most a stated share of those would be taken for a license.

Every paragraph is scored. The sum of what each gram can add at most in favour of any family is taken
first: where even that doesn't reach a family's least probability, the family's exact scores aren't needed. A
prediction is confirmed where nearly all of the paragraph's grams stand in that family's wording, the paragraph holds nearly
all of one form of it with all versions that the form gives, and the wording has every version that the paragraph gives and every word that
denies beside the same neighbours. Near-misses are made from the names too: sentences that deny them, and versions that no family has.

Defined cases: null and empty texts hold no paragraphs and get no family; a paragraph that repeats counts
each time; rows that repeat a key, or have none, are scanned each for itself by ``report``, and give
rows of that key in ``scan``; extra columns are not carried, whatever their names. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfold.common import cut

#: The names of each family, as notices give them, and its SPDX identifier.
NAMES = {
    "MIT": ("MIT", "the MIT License", "MIT license", "the Expat License"),
    "ISC": ("ISC", "the ISC License", "ISC license"),
    "BSD": ("BSD-3-Clause", "the BSD License", "the BSD 3-Clause License", "the BSD 2-Clause License", "the New BSD License", "a BSD-style license"),
    "Apache-2.0": ("Apache-2.0", "the Apache License, Version 2.0", "the Apache License 2.0", "Apache License Version 2.0, January 2004"),
    "GPL-2.0": ("GPL-2.0-only", "the GNU General Public License, version 2", "the GNU GPL version 2", "the GPLv2", "GNU General Public License v2.0", "the GPL version 2", "GPL-2.0-or-later", "the GPL version 2 or later"),
    "GPL-3.0": ("GPL-3.0-only", "the GNU General Public License, version 3", "the GNU GPL version 3", "the GPLv3", "GNU General Public License v3.0", "the GPL version 3", "GPL-3.0-or-later", "the GPL version 3 or later"),
    "LGPL-2.1": ("LGPL-2.1-only", "the GNU Lesser General Public License, version 2.1", "the GNU LGPL version 2.1", "the LGPLv2.1", "the LGPL version 2.1", "LGPL-2.1-or-later"),
    "LGPL-3.0": ("LGPL-3.0-only", "the GNU Lesser General Public License, version 3", "the GNU LGPL version 3", "the LGPLv3", "the LGPL version 3", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("AGPL-3.0-only", "the GNU Affero General Public License, version 3", "the GNU AGPL version 3", "the AGPLv3", "the AGPL version 3", "AGPL-3.0-or-later"),
    "MPL-2.0": ("MPL-2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"),
    "EPL-2.0": ("EPL-2.0", "the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "the EPL 2.0"),
    "BSL-1.0": ("BSL-1.0", "the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0", "the Creative Commons Zero 1.0 Universal License", "the CC0 1.0 Universal Public Domain Dedication"),
    "Unlicense": ("Unlicense", "the Unlicense", "The Unlicense"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 License"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 License"),
    "CC-BY-ND-4.0": ("CC-BY-ND-4.0", "CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "the Creative Commons Attribution-NoDerivatives 4.0 License"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial 4.0 License"),
    "CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: Sentences that notices put a family's name into.
FORMS = (
    "{}", "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}, see the LICENSE file for details.", "Distributed under {}.",
    "This software is released under {}.", "This file is available under {}.", "License: {}", "SPDX-License-Identifier: {}", "Published under the terms of {}.", "Dual licensed content is covered by {}.",
)
#: Wording of the licenses themselves.
WORDING = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
} | {
    f"CC-{short}-4.0": (f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License (\"Public License\").",)
    for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
}
#: Sentences that deny what the name in them would say.
DENIALS = (
    "This is not licensed under {}.", "We did not release this under {}.", "{} does not apply to this work.", "Never distributed under {}.", "This file is not covered by {}.", "It is no longer available under {}.", "Nothing here was published under {}.",
)
#: Words that deny.
DENYING = ("not", "never", "no", "nor", "neither", "nothing", "none", "cannot", "without", "isn", "wasn", "aren", "weren", "don", "doesn", "didn", "hasn", "haven")
#: Versions that no family here has, put in place of a name's own.
OTHER_VERSIONS = ("1", "1.1", "4")
#: Sentences about licenses, or in their words, that name no family.
NEAR_MISSES = (
    "All rights reserved.", "This license applies to you.", "He lost the license to drive.", "A fishing license was released under the new law.", "The work is free for any person.", "Released under great pressure.",
    "See the file for details.", "Version 2.0 of the program was released in January 2004.", "The general public may use the source.", "The following conditions are met.", "The license of this work is unknown.", "Licensed under terms that follow.",
    "Which license should I use for my project?", "The software is licensed, not sold.", "This file is part of the documentation.", "The plumber is licensed and insured.", "Distributed under the counter to friends.", "Published under the name of her brother.",
    "Our license server is down, see the support page.", "The public license hearing was held on Monday.", "Permission is granted to enter the building.", "Copyright and related rights are a matter of law.", "A driving license is required.", "The foundation published version 3 of its report.",
    "The attribution of the painting is in doubt.", "The commons is open to the public.", "An international license fee was paid.", "The library is free and open on Sunday.", "Apache helicopters were seen in January.", "The eclipse was visible to the public in 2004.",
    "The boost in software sales was noted.", "Mozilla released version 2.0 of the browser.", "The creative work of the commons was noted.", "Proprietary software may not be copied.", "The license text was changed by the author.", "This work is licensed under a license that the author wrote.",
)
UNKNOWN = "unknown"
#: Documents, and paragraphs of theirs, that the unknown class is learned from, at most; the share of those held out that may pass for a license.
DOCS, SAMPLE, FALSE_SHARE = 200, 400, 0.002
#: Probability from which a family is predicted; shares of grams from which it is confirmed.
LEAST, CONFIRM = 0.6, 0.8
ROUNDS, RATE, MOMENTUM, RIDGE = 800, 2.0, 0.9, 1e-5
#: Buckets of grams' hashes in which the most that a gram can add is held.
BUCKETS = 1 << 16
#: Places of sentences that, with all names put into them, calibrate the model instead of fitting it.
HELD = (4, 10)
#: Weight of a sentence of a license's own wording, where a sentence that names the license weighs 1.
WORDS = 8
#: A blank line, or a line's end after a sign that no word or clause goes on after.
BREAK = r"(?<=[^\p{L}\p{N}\s,(\-])[ \t]*\r?\n|\r?\n(?=[ \t]*\r?\n)"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: A word that gives a version; years are longer. The number before an item of a list gives none.
VERSION, ORDINAL = r"^([a-z]+v|v)?[0-9]{1,2}$", r"^[0-9]{1,2}$"
#: A version within a name.
NUMBER = re.compile(r"(?:(?<=L)|(?<![A-Za-z0-9.]))(v?)(\d+(?:\.\d+)?)(?![\d.])")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def grams(w: Column) -> Column:
    """Hashes of the distinct one- and two-grams."""
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.transform(w, lambda x: F.xxhash64(x)), pairs))


def unlisted(w: Column) -> Column:
    """The words without the number of an item of a list."""
    return F.when((F.size(w) > 1) & F.get(w, F.lit(0)).rlike(ORDINAL), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)


def versions(w: Column) -> Column:
    """Hashes of the words that give a version."""
    return F.transform(F.filter(unlisted(w), lambda x: x.rlike(VERSION)), lambda x: F.xxhash64(x))


def denials(w: Column) -> Column:
    """Hashes of the two-grams that hold a word that denies, and of that word where it is all there is."""
    w, deny = unlisted(w), lambda x: x.isin(*DENYING)
    pairs = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: deny(F.get(w, i)) | deny(F.get(w, i + 1)))
    return F.when(F.size(w) > 1, F.transform(pairs, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.transform(F.filter(w, deny), lambda x: F.xxhash64(x)))


def paragraphs(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(the columns kept, place, paragraph): every paragraph with a letter or digit."""
    return df.select(*keep, F.posexplode(F.split(text, BREAK)).alias("place", "paragraph")).filter(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def templates() -> dict[str, list[str]]:
    """All forms of each family: its names in each sentence, and its wording."""
    return {f: [*(form.format(n) for n in names for form in FORMS), *WORDING.get(f, ())] for f, names in NAMES.items()}


def unlike() -> list[list[str]]:
    """Near-misses made from the names, a list a sentence: those that deny, and other versions."""
    names = [n for ns in NAMES.values() for n in ns]
    others = [n[: m.start()] + m[1] + v + n[m.end() :] for n in names for v in OTHER_VERSIONS if "BSD" not in n and (m := NUMBER.search(n)) and float(m[2]) != float(v)]
    return [*([form.format(n) for n in names] for form in DENIALS), *([form.format(o) for o in others] for form in FORMS[:2])]


def _hashes(spark: SparkSession, texts: list[str]) -> list[tuple[list[int], list[int]]]:
    """Grams and versions of each text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", words(F.col("t")).alias("w")).select("k", grams(F.col("w")).alias("g"), versions(F.col("w")).alias("v")).collect()
    return [(r.g, r.v) for r in sorted(rows, key=lambda r: r.k)]


@dataclass
class Model:
    """Families with the unknown class last; weights of each gram; offsets; each family's forms, as hashes of all grams and of the versions."""

    names: list[str]
    weights: dict[int, list[float]]
    offsets: list[float]
    forms: dict[str, list[tuple[list[int], list[int]]]]


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a softmax regression, by gradient descent with momentum."""
    w, b = np.zeros((x.shape[1], classes), x.dtype), np.zeros(classes, x.dtype)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    want, weight = np.eye(classes, dtype=x.dtype)[y], weight.astype(x.dtype)
    for _ in range(ROUNDS):
        d = (_softmax(x @ w + b) - want) * weight[:, None]
        vw = MOMENTUM * vw - RATE * (x.T @ d + RIDGE * w)
        vb = MOMENTUM * vb - RATE * d.sum(0)
        w, b = w + vw, b + vb
    return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(spark: SparkSession, corpus: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the wording, and from at most ``sample`` paragraphs of about DOCS documents, which come to the driver."""
    names = [*NAMES, UNKNOWN]
    n = corpus.count()
    few = corpus.filter(F.pmod(F.xxhash64(F.lit("licences"), text), F.lit(1 << 40)) < int(min(1.0, DOCS / max(1, n)) * (1 << 40)))
    own = [r.paragraph for r in paragraphs(few, text).select(F.substring("paragraph", 1, 2_000).alias("paragraph")).orderBy(F.xxhash64("paragraph"), "paragraph").limit(sample).collect()]
    forms = templates()
    texts = [t for ts in forms.values() for t in ts]
    labels = [k for k, ts in enumerate(forms.values()) for _ in ts]
    made = unlike()
    both = _hashes(spark, [*texts, *NEAR_MISSES, *own, *(t for ts in made for t in ts)])
    hashed = [g for g, _ in both]
    apart_from = len(texts) + len(NEAR_MISSES)
    own, denied = hashed[apart_from : apart_from + len(own)], iter(hashed[apart_from + len(own) :])
    form_grams = [set(g) for g in hashed[: len(texts)]]
    # A paragraph of the corpus that says what a form says is no example of the unknown class.
    others = [g for g in own if g and not any(len(f & set(g)) >= 0.8 * len(f) and len(f & set(g)) >= 0.5 * len(g) for f in form_grams)]
    misses = hashed[len(texts) : apart_from]
    # A family's own wording is always fitted, and as weighty as the sentences that name it.
    wording = [k >= len(ts) - len(WORDING.get(f, ())) for f, ts in forms.items() for k in range(len(ts))]
    sentence = [k % len(FORMS) for ts in forms.values() for k in range(len(ts))]
    data = [(g, y, not own_words and k in HELD, WORDS if own_words else 1) for k, g, y, own_words in zip(sentence, hashed, labels, wording, strict=False)]
    data += [(next(denied), len(names) - 1, k in HELD, 1) for k, ts in enumerate(made) for _ in ts]
    named = len(data)  # what follows names no family
    data += [(g, len(names) - 1, k % 3 == 2, 1) for k, g in enumerate(misses)] + [(g, len(names) - 1, k % 2 == 1, 1) for k, g in enumerate(others)]
    place = {g: k for k, g in enumerate(sorted({g for gs, _, held, _ in data if not held for g in gs}))}
    x = np.zeros((len(data), len(place)), np.float32)
    for row, (gs, *_) in enumerate(data):
        for g in gs:
            if g in place:
                x[row, place[g]] = 1 / math.sqrt(len(gs))
    y, held = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    # The unknown class weighs as much as all families together.
    weight, unknown = np.array([d[3] for d in data], float)[~held], y[~held] == len(names) - 1
    for part in (unknown, ~unknown):
        weight[part] *= 0.5 / max(1.0, weight[part].sum())
    # Grams that stand in the same rows have the same weights: one column scaled by the root of their number steps as all of them would.
    _, one, which, many = np.unique(np.packbits(x[~held] > 0, axis=0).T, axis=0, return_index=True, return_inverse=True, return_counts=True)
    root = np.sqrt(many).astype(x.dtype)
    w, b = _descend(x[~held][:, one] * root, y[~held], weight, len(names))
    w = (w / root[:, None])[which.ravel()]
    z = x[held] @ w + b
    scale = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0), key=lambda s: -np.log(_softmax(z * s)[np.arange(len(z)), y[held]] + 1e-12).mean())
    w, b, z = w * scale, b * scale, z * scale
    apart = z[np.flatnonzero(held) >= named]
    lead = np.sort(apart[:, :-1].max(1) - apart[:, -1])[::-1]
    if len(lead):  # raise the unknown class until no more than the stated share of it passes
        b[-1] += max(0.0, float(lead[int(len(lead) * FALSE_SHARE)]) - math.log(LEAST / (1 - LEAST)))
    # A paragraph without any gram known is of the unknown class.
    b[-1] = max(b[-1], b[:-1].max() - math.log(LEAST / (1 - LEAST)) + 1e-6)
    kept = iter(both)
    return Model(names, {g: [float(v) for v in w[k]] for g, k in place.items()}, [float(v) for v in b], {f: [next(kept) for _ in ts] for f, ts in forms.items()})


def classify(rows: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(the columns kept, place, paragraph, family, probability, similarity, confirmed) of paragraphs taken for a license.

    ``keep`` and ``place`` tell paragraphs apart.
    """
    spark = rows.sparkSession
    by = [*keep, "place", "paragraph"]
    last = len(model.names) - 1
    best = {g: max(w[:-1]) - w[-1] for g, w in model.weights.items()}
    most = max(model.offsets[:-1]) - model.offsets[-1]
    # A family's probability is at least LEAST only if its lead on the unknown class is at least this.
    least = math.log(LEAST / (1 - LEAST))
    bound = [0.0] * BUCKETS
    for g, m in best.items():
        bound[g % BUCKETS] = max(bound[g % BUCKETS], m)
    table = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram long, w array<double>")
    # A literal, so the sum is taken in the row; grams that share a bucket have the greater one's bound.
    bounds = F.split(F.lit(",".join(f"{x:.9g}" if x else "0" for x in bound)), ",").cast("array<double>")
    # The number keeps Spark from moving the filter below, where each use of the words would make them anew.
    split = rows.select(*by, words(F.col("paragraph")).alias("_w")).select(*by, grams(F.col("_w")).alias("_g"), F.monotonically_increasing_id().alias("_b"))
    lead = F.aggregate("_g", F.lit(0.0), lambda a, x: a + F.get(bounds, F.pmod(x, F.lit(BUCKETS)).cast("int")))
    again = cut(split.filter(lead / F.sqrt(F.size("_g")) + F.lit(most + 1e-6) >= F.lit(least)).select(*by, F.size("_g").alias("_n"), "_g", "_b"))
    # As many rows as the bounded sample and the forms hold grams. The sums go by number; texts come back to what is predicted.
    sums = again.select("_b", "_n", F.explode("_g").alias("gram")).join(F.broadcast(table), "gram").groupBy("_b", "_n").agg(*(F.sum(F.col("w")[c]).alias(f"_z{c}") for c in range(last + 1)))
    z = F.array(*(F.col(f"_z{c}") / F.sqrt("_n") + F.lit(model.offsets[c]) for c in range(last + 1)))
    scored = sums.select("_b", z.alias("_z")).withColumn("_e", F.transform("_z", lambda x: F.exp(x - F.array_max("_z"))))
    scored = scored.withColumn("probability", F.array_max("_e") / F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    scored = scored.withColumn("family", F.get(F.array(*map(F.lit, model.names)), F.array_position("_e", F.array_max("_e")).cast("int") - 1)).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST)).select("_b", "family", "probability").join(again, "_b")
    scored = scored.withColumn("_w", words(F.col("paragraph"))).withColumn("_v", versions(F.col("_w"))).withColumn("_d", denials(F.col("_w"))).drop("_w")
    forms = spark.createDataFrame([(f, g, v, sorted({x for gs, _ in model.forms[f] for x in gs})) for f in model.forms for g, v in model.forms[f]], "family string, form array<long>, numbers array<long>, wording array<long>")
    held = F.size(F.array_intersect("_g", "form")) / F.size("form")
    known = F.size(F.array_intersect("_g", "wording")) / F.col("_n")
    agrees = (F.size(F.array_except("numbers", "_g")) == 0) & (F.size(F.array_except("_v", "wording")) == 0) & (F.size(F.array_except("_d", "wording")) == 0)
    alike = F.least(held, known)
    judged = scored.join(F.broadcast(forms), "family").groupBy(*by, "_b", "family", "probability").agg(F.max(alike).alias("similarity"), F.bool_or((alike >= CONFIRM) & agrees).alias("confirmed"))
    return judged.drop("_b")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, place, paragraph, family, probability, similarity, confirmed) of the license paragraphs of all texts."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    found = classify(paragraphs(rows, "_text", ("_key", "_row")), model or fit(df.sparkSession, rows, "_text"), ("_key", "_row"))
    return found.select(F.col("_key").alias(key), "place", "paragraph", "family", "probability", "similarity", "confirmed")


def report(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, n_paragraphs, families, probability, confirmed) of every row: license paragraphs, the families' names sorted, the
    greatest probability, and whether all were confirmed. Equal texts are equal rows' own: each is told by its text."""
    texts = df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_digest"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    found = classify(paragraphs(texts, "_text", ("_digest", "_row")), model or fit(df.sparkSession, texts, "_text"), ("_digest", "_row"))
    each = found.groupBy("_digest", "_row").agg(F.count("*").alias("n_paragraphs"), F.array_sort(F.collect_set("family")).alias("families"), F.max("probability").alias("probability"), F.bool_and("confirmed").alias("confirmed"))
    # Rows of one text found the same.
    one = cut(each.groupBy("_digest").agg(F.min(F.struct("n_paragraphs", "families", "probability", "confirmed")).alias("_r")).select("_digest", "_r.*"))
    joined = df.select(F.col(key).alias(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_digest")).join(one, "_digest", "left")
    return joined.select(key, F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
