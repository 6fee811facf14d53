"""Confirmed families: versions and denials must agree, whole wording is known, and sentences never fitted are told."""

import re

import pytest

from twinfold.llm import licences


@pytest.fixture(scope="module")
def model(spark):
    body = [(k, " ".join(f"plain{(k * 7 + i * 3) % 50}" for i in range(12)) + ".") for k in range(60)]
    return licences.fit(spark, spark.createDataFrame(body, "doc_id int, text string"))


def found(spark, model, texts):
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model=model).collect()
    return {texts[r.doc_id]: r for r in rows}


WRONG_VERSIONS = [
    "Licensed under the GNU General Public License version 1.", "licensed under the GNU General Public License version 1", "Released under the Apache License, Version 1.1.", "Published under the terms of the GNU General Public License.",
    "Licensed under the LGPL version 2.", "Licensed under CC BY-NC 3.0.", "This work is licensed under a Creative Commons Attribution 2.5 International License.", "Licensed under the Mozilla Public License 1.1.", "Licensed under the Eclipse Public License, version 7.0.",
]
DENIED = [
    "We did not release this under the MIT License", "This file is not released under the MIT License.", "Never licensed under the ISC license.", "This package isn't available under the Apache License 2.0.", "Not MIT.", "No code here is licensed under the GPLv3.", "None of it is under CC0 1.0.",
    "Nobody said this was licensed under the MIT License, and it is not.", "Released under the MIT License? No, not under the MIT License.",
]
RIGHT = {
    "licensed under the GPL version 2 or later": "GPL-2.0", "Offered under the terms of the GNU GPL version 3.": None, "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "MIT",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "AGPL-3.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "Apache-2.0",
    'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License ("Public License").': "CC-BY-SA-4.0",
    "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_other_versions_and_denials_are_not_confirmed(spark, model):
    rows = found(spark, model, [*WRONG_VERSIONS, *DENIED])
    assert not [t for t, r in rows.items() if r.confirmed]
    assert not rows.keys() & set(WRONG_VERSIONS[:5])


def test_wording_and_versions_that_agree_are_confirmed(spark, model):
    rows = found(spark, model, list(RIGHT))
    for text, family in RIGHT.items():
        if family:
            assert (rows[text].family, rows[text].confirmed) == (family, True), text


def test_whole_sentences_are_held_out_of_the_fit(spark, model):
    """Every name of every family in sentences that no fit has seen: the right family, or none."""
    want = {form.format(n): f for f, ns in licences.NAMES.items() for n in ns for form in ("The sources are licensed under {}.", "Released by its authors under {}.")}
    rows = found(spark, model, list(want))
    assert all(rows[t].family == f for t, f in want.items() if t in rows)
    assert len(rows) >= 0.9 * len(want)


def test_near_misses_hold_no_version_of_their_family():
    denied, others = licences.unlike()[: len(licences.DENIALS)], licences.unlike()[len(licences.DENIALS) :]
    assert all(len(ts) == sum(map(len, licences.NAMES.values())) for ts in denied)
    names = {n for ns in licences.NAMES.values() for n in ns}
    assert others[0] and not names & set(others[0])


def test_confirmation_equals_brute_force(spark, model):
    """Similarity, versions and denials computed from words in plain Python, given the family that was predicted."""

    def split(t):
        return [w for w in re.split(r"[^\w]+|_", t.lower()) if w]

    def grams(w):
        return {*w, *zip(w, w[1:], strict=False)}

    def unlisted(w):
        return w[1:] if len(w) > 1 and re.fullmatch(r"[0-9]{1,2}", w[0]) else w

    def versions(w):
        return {x for x in unlisted(w) if re.fullmatch(r"([a-z]+v|v)?[0-9]{1,2}", x)}

    forms = {f: [split(t) for t in ts] for f, ts in licences.templates().items()}
    for text, r in found(spark, model, [*WRONG_VERSIONS, *DENIED, *RIGHT, *(form.format(n) for ns in licences.NAMES.values() for n in ns for form in licences.DENIALS)]).items():
        w = split(text)
        g, wording = grams(w), set().union(*(grams(f) for f in forms[r.family]))
        alike = {k: min(len(g & grams(f)) / len(grams(f)), len(g & wording) / len(g)) for k, f in enumerate(forms[r.family])}
        u = unlisted(w)
        denying = {p for p in (zip(u, u[1:], strict=False) if len(u) > 1 else u) if set([p] if isinstance(p, str) else p) & set(licences.DENYING)}
        fits = versions(w) <= wording and denying <= wording
        assert r.similarity == pytest.approx(max(alike.values()))
        assert r.confirmed == any(a >= licences.CONFIRM and fits and versions(forms[r.family][k]) <= g for k, a in alike.items()), text


def test_empty_and_odd_paragraphs(spark, model):
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "Released under the MIT License."), (3, "not"), (4, "7"), (5, "MIT " * 20_000)], "doc_id int, text string")
    got = licences.scan(rows, model=model).collect()
    assert {r.doc_id for r in got if r.confirmed} <= {None, 5}
    assert licences.scan(rows.filter("false"), model=model).count() == 0
