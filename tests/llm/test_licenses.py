"""The licence scan against a plain matcher, over all rules and orders, and on long texts."""

import itertools
import random
import re
import time

import pytest

pytest.importorskip("graticule.llm")

from graticule.llm import licenses

NOTICES = {
    "Licensed under the Mozilla Public License 2.0": "MPL-2.0",
    "distributed under the terms of the GNU GPL version 2 or later": "GPL-2.0-or-later",
    "available under a BSD 3-clause license": "BSD-3-Clause",
    "this is free and unencumbered software released into the public domain": "Unlicense",
}
SPDX = {"// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only)": ["Apache-2.0", "GPL-2.0-only"], "xspdx-license-identifier: ISC": ["ISC"]}
NOISE = ["int main(void) { return 0; }", "Über uns: nothing here", "x", "", "copyright 2020 by me"]


def plain(text):
    """Every place of the normalised text, with the sentences as plain strings, the patterns as plain expressions, the rules by search over all choices."""
    at, whole = 0, licenses.normalise(text)
    starts = {0} | {m.end() for m in re.finditer(" ", whole)}
    sentences = sorted(((licenses.normalise(s), n) for n, s in licenses.SENTENCES.items()), key=lambda x: -len(x[0]))
    out = []
    while at < len(whole):
        if at in starts:
            hit = next(((len(p), n) for p, n in sentences if whole.startswith(p, at) and whole[at + len(p) : at + len(p) + 1] in ("", " ")), None)
            if hit is None:
                hit = next(((m.end() - at, n) for n, p in licenses.PATTERNS.items() if (m := re.compile(p + r"\b").match(whole, at))), None)
            if hit:
                out.append(hit[1])
                at += hit[0]
                continue
        at += 1
    return out


def rules_of(ids, gap=licenses.GAP):
    rules = [*licenses.RULES, *((v, [k]) for k, v in licenses.ALONE.items())]

    def ends(at, rest):
        if not rest:
            return [at]
        return [e for i in range(at + 1, min(at + 2 + gap, len(ids))) if ids[i] == rest[0] for e in ends(i, rest[1:])]

    out, at = [], 0
    while at < len(ids):
        hit = next(((lic, min(e)) for lic, rule in rules if ids[at] == rule[0] and (e := ends(at, rule[1:]))), None)
        if hit:
            out.append(hit[0])
            at = hit[1]
        at += 1
    return out


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.SENTENCES, licenses.RULES)


def test_every_rule_in_every_order(scanner):
    for _, rule in licenses.RULES:
        for order in itertools.permutations(rule):
            for between in ([], ["all-rights"], ["mit-short", "all-rights"], ["mit-short", "all-rights", "cc-by"]):
                ids = [x for name in order for x in (name, *between)]
                text = "\n".join(licenses.SENTENCES[n] for n in ids)
                assert scanner.identify(text.encode()) == plain(text) == ids
                assert scanner.match(ids) == rules_of(ids)


def test_random_texts(scanner):
    rng = random.Random(8)
    lines = [*licenses.SENTENCES.values(), *NOTICES, *NOISE]
    for _ in range(300):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))
        ids = scanner.identify(text.encode())
        assert ids == plain(text), text
        assert scanner.match(ids) == rules_of(ids)


def test_places_of_spdx_lines(scanner):
    """Identifiers of SPDX lines stand where their lines do among sentences and notices."""
    rng = random.Random(9)
    said = {**{licenses.SENTENCES[n]: lic for lic, n in (("MIT", "mit-short"), ("CC-BY-4.0", "cc-by"), ("all-rights-reserved", "all-rights"))}, **NOTICES}
    for _ in range(200):
        parts = [rng.choice([*said, *SPDX, *NOISE]) for _ in range(rng.randrange(1, 15))]
        want = [lic for p in parts for lic in ([said[p]] if p in said else SPDX.get(p, []))]
        assert scanner.match(scanner.identify("\n".join(parts).encode())) == want, parts


def test_a_rule_may_need_a_later_sentence(scanner):
    scanner = licenses.Scanner({}, [("X", ["a", "b", "c"])], patterns=False)
    assert scanner.match(["a", "b", "b", "x", "x", "c"]) == ["X"]
    assert scanner.match(["a", "b", "x", "x", "x", "c"]) == []


def test_long_texts_in_linear_time(scanner):
    """20,000 SPDX lines and as many notices among sentences, of 1 to 3 MB."""
    for line in ("// SPDX-License-Identifier: MIT\nint x;\n", "Licensed under the Apache License 2.0, see above\n", licenses.SENTENCES["bsd-source"] + "\nit is licensed under the ISC license\n"):
        began = time.perf_counter()
        ids = scanner.identify((line * 20_000).encode())
        took = time.perf_counter() - began
        assert len(ids) >= 20_000
        assert took < 8


def test_extra_columns(spark):
    rows = [(1, "Released under the MIT License.", ["x"], 4, "a"), (1, "Released under the MIT License.", ["x"], 4, "a"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses array<string>, n_matches int, sentence_ids string")
    got = sorted((r["doc_id"] or 0, r["licenses"]) for r in licenses.scan_documents(docs).collect())
    assert got == [(0, []), (1, ["MIT"]), (1, ["MIT"])]
