"""License scans by sentence-rule recognition.

A text is cut into sentences, at line ends and after `.`, `;`, `:`, `!` or `?` followed by white space. A sentence is
normalised (lower case, every run of characters other than letters and digits becomes one blank) and looked up among the
known licence sentences, which gives it an identifier. The identifiers of a text, in order, are matched against ordered
rules: a rule is a sequence of identifiers that must occur in that order, with at most `GAP` other known sentences
between neighbours. Rules are tried in their order from each place on, the first that matches wins, and matching goes on
after it, so that longer rules, which stand first, are not mistaken for the shorter ones they hold.

A known sentence may run over several lines. A version number in a sentence is kept: the known sentences name the version they mean.

Beside whole sentences, patterns with slots (an organisation, a program, a wording) are searched in the normalised text,
wherever they stand: short notices inside longer sentences, the endorsement clause, the typical sentences of further
licences, and SPDX lines. A pattern's place is where it begins; one that lies within a known sentence or within a longer
pattern doesn't count. An SPDX expression gives each of its identifiers, as it is written there.

Edge cases: a null or empty text matches nothing; every row is returned, with an empty list where nothing matches; rows
that repeat a doc_id are scanned each; an empty table gives an empty result; extra columns are ignored, whatever their
names. A text is scanned whole, in time that follows its length: places of spans and of SPDX lines are carried on, not
counted anew. Of known sentences that begin at one place the longest counts, of patterns and rules the first in order; the
sentences of a rule may be found in any way within the gap, and the match ends as early as it can.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import map_texts
from graticule.llm.textkernel import Block

#: Other known sentences that may stand between two neighbours of a rule.
GAP = 2

# Known licence sentences by identifier.
SENTENCES = {
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-the-license": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may-not-use": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free-software": "This program is free software:",
    "gpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "all-rights": "All rights reserved.",
}

# Ordered rules, the licence and its sentences in order.
RULES = [
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-the-license", "apache-may-not-use", "apache-obtain"]),
    ("GPL-3.0-or-later", ["gpl-free-software", "gpl3-redistribute", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-free-software", "gpl2-redistribute", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("Apache-2.0", ["apache-the-license"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("all-rights-reserved", ["all-rights"]),
]

_ISSUED = r"(?<!not )(?<!never )(?:licensed|released|distributed|available|published|provided|covered|governed|redistribute it(?: and or modify it)?)(?: (?:to you|as is|free of charge|freely|only))?(?: (?:under|by))(?: (?:the|an?))?(?: terms(?: and conditions)? of(?: the)?)?"
_V = r" ?(?:as published by the free software foundation )?(?:either )?(?:version ?|v ?)?"
_LATER = r" (?:of the license )?(?:or (?:at your option )?(?:any )?(?:later|newer)|or higher)"

# Licences that a notice names: the SPDX identifier and the name, as a pattern over normalised text.
NAMES = [
    ("Apache-2.0", r"apache (?:software )?license (?:version |v ?)?2(?: 0)?"),
    ("MPL-2.0", r"mozilla public license (?:version |v ?|v )?2 0"),
    ("EPL-2.0", r"eclipse public license (?:version |v ?|v )?2 0"),
    ("EPL-1.0", r"eclipse public license (?:version |v ?|v )?1 0"),
    ("BSL-1.0", r"boost software license(?: version 1 0)?"),
    ("BSD-3-Clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: style)?(?: license)?"),
    ("BSD-2-Clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?"),
    ("CC-BY-NC-SA-4.0", r"(?:cc by nc sa|creative commons attribution noncommercial sharealike) 4 0"),
    ("CC-BY-NC-ND-4.0", r"(?:cc by nc nd|creative commons attribution noncommercial noderivatives) 4 0"),
    ("CC-BY-NC-4.0", r"(?:cc by nc|creative commons attribution noncommercial) 4 0"),
    ("CC-BY-SA-4.0", r"(?:cc by sa|creative commons attribution sharealike) 4 0"),
    ("CC-BY-ND-4.0", r"(?:cc by nd|creative commons attribution noderivatives) 4 0"),
    ("CC-BY-4.0", r"(?:cc by|creative commons attribution) 4 0"),
    ("CC0-1.0", r"(?:cc0(?: 1 0)?|creative commons (?:zero|cc0)(?: v?1 0)?)"),
    ("ISC", r"isc license"),
    ("Zlib", r"zlib(?: libpng)? license"),
    ("Unlicense", r"unlicense"),
    ("MIT", r"(?:mit|expat)(?: style)? license"),
]
for _name, _full, _short, _versions in (("AGPL", "affero general public license", "agpl", ("3.0",)), ("LGPL", "(?:lesser|library) general public license", "lgpl", ("2.0", "2.1", "3.0")), ("GPL", "general public license", "gpl", ("1.0", "2.0", "3.0"))):
    for _v in _versions:
        _number = _v.removesuffix(".0") + ("(?: 0)?" if _v.endswith(".0") else "")
        _number = _number.replace(".", " ") + (r"(?! [1-9]\b)" if _v.endswith(".0") else "")
        _whole = rf"(?:(?:gnu )?{_full}(?: {_short})?|(?:gnu )?{_short})" + _V + _number
        NAMES += [(f"{_name}-{_v}-or-later", _whole + _LATER), (f"{_name}-{_v}-only", _whole)]

# Sentences with slots by identifier, as patterns over normalised text.
PATTERNS = {
    **{f"named:{i}:{name}": rf"{_ISSUED} {words}" for i, (name, words) in enumerate(NAMES)},
    "bsd-endorse": r"neither the names? of (?:[a-z0-9]+ ){1,16}?nor the names? of (?:[a-z0-9]+ ){1,6}?may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-grant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense-grant": r"this is free and unencumbered software released into the public domain",
    "cc0-title": r"cc0 1 0 universal",
    "mpl2-notice": r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0",
    "epl2-title": r"eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license",
}
# The licence that each of those names by itself.
ALONE = {"isc-grant": "ISC", "zlib-grant": "Zlib", "bsl-grant": "BSL-1.0", "unlicense-grant": "Unlicense", "cc0-title": "CC0-1.0", "mpl2-notice": "MPL-2.0", "epl2-title": "EPL-2.0"}
ALONE |= {name: name.split(":")[2] for name in PATTERNS if name.startswith("named:")}

_SPDX = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
_SLOTTED = [(name, re.compile(p + r"\b")) for name, p in PATTERNS.items()]
#: Where a pattern may begin, and what a text that holds any of them has.
_STARTS = re.compile(r"\b(?:licensed|released|distributed|available|published|provided|covered|governed|redistribute it|neither the name|permission (?:to use|is )|this (?:is free and|source code form)|cc0 1 0|eclipse public license v)")
_HINTS = ("licens", "neither the name", "permission", "unencumbered", "cc0", "gpl", "bsd", "cc by", "creative commons")

_PLAIN, _WORD = re.compile(r"[^a-z0-9]+"), re.compile(r"[a-z0-9]+")
_END = re.compile(rb"[.;:!?]*[ \t\r\f\v]*\n+|[.;:!?]+[ \t\r\f\v]+")


def normalise(sentence: str) -> str:
    """Lower case with one blank for every run of characters other than letters and digits."""
    return _PLAIN.sub(" ", sentence.lower()).strip()


class Scanner:
    """Known sentences and rules, ready to match.

    A known sentence may be broken into lines, or hold sentence ends itself, so it's matched against a run of parts of
    the text, as many as make up its length.
    """

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]], gap: int = GAP, patterns: bool = True):
        self.gap = gap
        self.rules = [*rules, *((licence, [name]) for name, licence in ALONE.items())] if patterns else rules
        self.patterns = _SLOTTED if patterns else []
        self.known: dict[str, list[tuple[str, str]]] = {}  # by first word
        for name, text in sentences.items():
            plain = normalise(text)
            self.known.setdefault(plain.partition(" ")[0], []).append((plain, name))
        for found in self.known.values():
            found.sort(key=lambda x: -len(x[0]))

    def identify(self, text: bytes) -> list[str]:
        """Identifiers of the known sentences and patterns of a text, in order."""
        parts = [p for p in map(normalise, split(text)) if p]
        found, spans, at = [], [], 0
        while at < len(parts):
            after = at + 1
            for plain, name in self.known.get(parts[at].partition(" ")[0], ()):
                if plain.startswith(parts[at]):
                    upto, joined = at + 1, parts[at]
                    while len(joined) < len(plain) and upto < len(parts):
                        joined += " " + parts[upto]
                        upto += 1
                    if joined == plain:
                        found.append(name)
                        spans.append((at, upto))
                        after = upto
                        break
            at = after
        more = self.slotted(text, parts, spans) if self.patterns else []
        if not more:
            return found
        starts = places(parts)
        return [name for _, name in sorted([*((starts[a], n) for (a, _), n in zip(spans, found, strict=True)), *more], key=lambda x: x[0])]

    def slotted(self, text: bytes, parts: list[str], spans: list[tuple[int, int]]) -> list[tuple[int, str]]:
        """Places and identifiers of the patterns and SPDX identifiers outside the known sentences."""
        plain = " ".join(parts).replace("licence", "license")
        if not any(h in plain for h in _HINTS):
            return []
        starts = places(parts)
        edges = [starts[a] for a, _ in spans]
        inside = [0, *(starts[b] for _, b in spans)]  # the end of the last span that begins at a place or before
        out, done = [], 0
        for begin in _STARTS.finditer(plain):
            at = begin.start()
            if at < done or at < inside[bisect_right(edges, at)]:
                continue
            for name, pattern in self.patterns:
                if hit := pattern.match(plain, at):
                    out.append((at, name))
                    done = hit.end()
                    break
        if "spdx license identifier" in plain:
            upto, letters, words, last = 0, 0, 0, ""  # of the text so far: letters and words after normalising
            for line in _SPDX.finditer(text):
                between = text[upto : line.start()].decode("utf-8", "replace").lower()
                more = _WORD.findall(between)
                letters += sum(map(len, more))
                words += len(more) - bool(more and _WORD.match(between) and _WORD.match(last))
                upto, last = line.start(), between[-1:] or last
                at = letters + max(0, words - 1)
                expression = re.sub(r"\bWITH\s+\S+", " ", line.group(1).decode("utf-8", "replace"), flags=re.I)
                one = _SPDX_ID.pattern
                whole = re.match(rf"[\s()]*{one}(?:[\s()]+(?:AND|OR)[\s()]+{one})*", expression, re.I)
                out += [(at, "spdx:" + w) for w in _SPDX_ID.findall(whole.group() if whole else "") if w.upper() not in ("AND", "OR", "NONE", "NOASSERTION")]
        return out

    def match(self, ids: list[str]) -> list[str]:
        """Licences of the rules that match, in order of their places."""
        out, at = [], 0
        while at < len(ids):
            if ids[at].startswith("spdx:"):
                out.append(ids[at][5:])
            for licence, rule in self.rules:
                if ids[at] != rule[0]:
                    continue
                ends = [at]  # where the sentences of the rule so far can end
                for wanted in rule[1:]:
                    ends = sorted({i for end in ends for i in range(end + 1, min(end + 2 + self.gap, len(ids))) if ids[i] == wanted})
                if ends:
                    out.append(licence)
                    at = ends[0]
                    break
            at += 1
        return out


def places(parts: list[str]) -> list[int]:
    """Where the parts begin in the normalised text, and its end."""
    out = [0]
    for part in parts:
        out.append(out[-1] + len(part) + 1)
    return out


def split(text: bytes) -> list[str]:
    """Sentences of a text."""
    return [p.decode("utf-8", "replace") for p in _END.split(text)]


def scan_block(block: Block, scanner: Scanner) -> dict[str, object]:
    """Known sentences and licences of each text."""
    ids = [scanner.identify(block.text(i)) if block.offsets[i + 1] > block.offsets[i] else [] for i in range(block.n)]
    licences = [scanner.match(x) for x in ids]
    return {"sentence_ids": ids, "licenses": [list(dict.fromkeys(x)) for x in licences], "n_matches": np.array([len(x) for x in licences], np.int64)}


def scan_documents(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, the known sentences in order, the distinct licences in order and the number of matched rules."""
    scanner = Scanner(sentences or SENTENCES, rules or RULES, patterns=sentences is None and rules is None)
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    fields = [("sentence_ids", "array<string>"), ("licenses", "array<string>"), ("n_matches", "long")]
    return map_texts(rows, lambda block: scan_block(block, scanner), fields, ["doc_id"])
