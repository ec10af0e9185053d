"""License scans by ordered signature rules.

Each rule is a hand-written regular expression over the normalised text (words joined by single
spaces) with a label, a priority, and keywords without which it cannot match. A text's distinct
words select the rules worth running, so most texts run none. Detections then compete: in order
of priority, then length, then place, one is kept unless it lies within the interval of a kept
one or overlaps one of higher priority. Base phrases are found apart from the rules and
their labels always stay.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII.

Defined results: null and empty texts have no words, no labels and score 0. Rows that repeat a
document are scanned each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetide.llm.decontamination import words_of

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Rule(NamedTuple):
    label: str
    priority: int  # greater wins
    confidence: float
    keywords: frozenset[str]  # all must occur
    pattern: re.Pattern


# label: names under which a license is known, as patterns over normalised words. A name's plain
# words are its keywords.
NAMES: dict[str, tuple[str, ...]] = {
    "gpl-1.0": (r"gnu general public license(?: as published by the free software foundation)? (?:version|v) ?1(?: 0)?", r"gpl(?: version)? v?1(?: 0)?"),
    "gpl-2.0": (r"gnu general public license(?: as published by the free software foundation)? (?:version|v) ?2(?: 0)?", r"gpl(?: version)? v?2(?: 0)?", r"gplv2"),
    "gpl-3.0": (r"gnu general public license(?: as published by the free software foundation)? (?:version|v) ?3(?: 0)?", r"gpl(?: version)? v?3(?: 0)?", r"gplv3"),
    "lgpl-2.0": (r"gnu library general public license", r"lgpl(?: version)? v?2 0"),
    "lgpl-2.1": (r"gnu lesser general public license (?:version|v) ?2 1", r"lgpl(?: version)? v?2 1", r"lgplv2 1"),
    "lgpl-3.0": (r"gnu lesser general public license (?:version|v) ?3(?: 0)?", r"lgpl(?: version)? v?3(?: 0)?", r"lgplv3"),
    "agpl-3.0": (r"gnu affero general public license(?: (?:version|v) ?3(?: 0)?)?", r"agpl(?: version)? v?3(?: 0)?", r"agplv3"),
    "gfdl": (r"gnu free documentation license(?: (?:version|v) ?1 [0-3])?", r"gfdl(?: 1 [0-3])?"),
    "apache-1.0": (r"apache(?: software)? license (?:version|v) ?1 0",),
    "apache-1.1": (r"apache(?: software)? license (?:version|v) ?1 1",),
    "apache-2.0": (r"apache(?: software)? license (?:version|v) ?2(?: 0)?", r"apache license 2 0", r"apache 2 0 license", r"asl 2 0"),
    "mit": (r"mit license", r"mit x11 license", r"expat license"),
    "mit-0": (r"mit no attribution(?: license)?",),
    "bsd-1-clause": (r"bsd 1 clause(?: license)?", r"one clause bsd license"),
    "bsd-2-clause": (r"bsd 2 clause(?: simplified)?(?: license)?", r"simplified bsd license", r"freebsd license", r"two clause bsd license", r"2 clause bsd(?: license)?"),
    "bsd-3-clause": (r"bsd 3 clause(?: new| revised)?(?: license)?", r"new bsd license", r"modified bsd license", r"three clause bsd license", r"3 clause bsd(?: license)?"),
    "bsd-4-clause": (r"bsd 4 clause(?: original)?(?: license)?", r"original bsd license", r"four clause bsd license"),
    "0bsd": (r"bsd zero clause license", r"zero clause bsd(?: license)?"),
    "isc": (r"isc license", r"internet systems consortium license"),
    "zlib": (r"zlib license", r"zlib libpng license"),
    "mpl-1.0": (r"mozilla public license (?:version|v) ?1 0", r"mpl 1 0"),
    "mpl-1.1": (r"mozilla public license (?:version|v) ?1 1", r"mpl 1 1"),
    "mpl-2.0": (r"mozilla public license (?:version|v) ?2(?: 0)?", r"mpl 2 0"),
    "epl-1.0": (r"eclipse public license (?:version|v)? ?1(?: 0)?", r"epl 1 0"),
    "epl-2.0": (r"eclipse public license (?:version|v)? ?2(?: 0)?", r"epl 2 0"),
    "eupl-1.2": (r"european union public licence(?: (?:version|v) ?1 2)?", r"eupl 1 2"),
    "cddl-1.0": (r"common development and distribution license(?: (?:version|v)? ?1(?: [01])?)?", r"cddl 1 [01]"),
    "cpl-1.0": (r"common public license(?: (?:version|v)? ?1 0)?",),
    "artistic-1.0": (r"artistic license(?: (?:version|v)? ?1(?: 0)?)",),
    "artistic-2.0": (r"artistic license (?:version|v)? ?2(?: 0)?",),
    "bsl-1.0": (r"boost software license(?: (?:version|v)? ?1 0)?",),
    "busl-1.1": (r"business source license(?: 1 1)?",),
    "unlicense": (r"the unlicense", r"this is free and unencumbered software released into the public domain"),
    "wtfpl": (r"do what the fuck you want to public license", r"wtfpl"),
    "psf-2.0": (r"python software foundation license(?: version 2)?", r"psf license"),
    "postgresql": (r"postgresql license",),
    "openssl": (r"openssl license",),
    "php-3.0": (r"php license(?: (?:version|v)? ?3 0[01]?)?",),
    "ruby": (r"ruby license", r"same terms as ruby"),
    "perl": (r"same terms as perl(?: itself)?",),
    "ofl-1.1": (r"sil open font license(?: (?:version|v)? ?1 1)?", r"open font license 1 1"),
    "odbl-1.0": (r"open database license(?: (?:version|v)? ?1 0)?", r"odbl"),
    "odc-by-1.0": (r"open data commons attribution license",),
    "pddl-1.0": (r"public domain dedication and license",),
    "cc0-1.0": (r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero", r"cc zero"),
    "cc-by-1.0": (r"cc by 1 0", r"creative commons attribution 1 0"),
    "cc-by-2.0": (r"cc by 2 [05]", r"creative commons attribution 2 [05]"),
    "cc-by-3.0": (r"cc by 3 0", r"creative commons attribution 3 0"),
    "cc-by-4.0": (r"cc by 4 0", r"creative commons attribution 4 0", r"creativecommons org licenses by 4 0"),
    "cc-by-sa-2.0": (r"cc by sa 2 [05]", r"creative commons attribution share ?alike 2 [05]"),
    "cc-by-sa-3.0": (r"cc by sa 3 0", r"creative commons attribution share ?alike 3 0"),
    "cc-by-sa-4.0": (r"cc by sa 4 0", r"creative commons attribution share ?alike 4 0", r"creativecommons org licenses by sa 4 0"),
    "cc-by-nd-3.0": (r"cc by nd 3 0", r"creative commons attribution no ?derivatives 3 0"),
    "cc-by-nd-4.0": (r"cc by nd 4 0", r"creative commons attribution no ?derivatives 4 0"),
    "cc-by-nc-2.0": (r"cc by nc 2 [05]", r"creative commons attribution non ?commercial 2 [05]"),
    "cc-by-nc-3.0": (r"cc by nc 3 0", r"creative commons attribution non ?commercial 3 0"),
    "cc-by-nc-4.0": (r"cc by nc 4 0", r"creative commons attribution non ?commercial 4 0", r"creativecommons org licenses by nc 4 0"),
    "cc-by-nc-sa-3.0": (r"cc by nc sa 3 0", r"creative commons attribution non ?commercial share ?alike 3 0"),
    "cc-by-nc-sa-4.0": (r"cc by nc sa 4 0", r"creative commons attribution non ?commercial share ?alike 4 0"),
    "cc-by-nc-nd-3.0": (r"cc by nc nd 3 0", r"creative commons attribution non ?commercial no ?derivatives 3 0"),
    "cc-by-nc-nd-4.0": (r"cc by nc nd 4 0", r"creative commons attribution non ?commercial no ?derivatives 4 0"),
    "artistic": (r"artistic licen[cs]e",),
    "gpl": (r"under (?:the )?(?:terms of the )?(?:gnu )?gpl",),
    "lgpl": (r"under (?:the )?(?:terms of the )?(?:gnu )?lgpl", r"gnu lesser general public license"),
    "agpl": (r"under (?:the )?(?:terms of the )?(?:gnu )?agpl",),
    "epl": (r"eclipse public license",),
    "mpl": (r"mozilla public license",),
    "cecill": (r"cecill(?: [bc])?(?: free software)? licen[cs]e", r"cecill 2 [01]"),
    "ms-pl": (r"microsoft public license",),
    "ms-rl": (r"microsoft reciprocal license",),
    "afl-3.0": (r"academic free license(?: (?:version|v)? ?3 0)?",),
    "osl-3.0": (r"open software license(?: (?:version|v)? ?3 0)?",),
    "upl-1.0": (r"universal permissive license(?: (?:version|v)? ?1 0)?",),
    "ncsa": (r"university of illinois ncsa open source license", r"ncsa license"),
    "vim": (r"vim license",),
    "w3c": (r"w3c software notice and license", r"w3c license"),
    "sspl-1.0": (r"server side public license(?: (?:version|v)? ?1)?",),
    "elastic-2.0": (r"elastic license(?: 2 0)?",),
    "libpng": (r"libpng license",),
    "curl": (r"curl license",),
    "unicode": (r"unicode license(?: agreement)?",),
    "openrail": (r"(?:creativeml )?open rail [ms](?: license)?", r"openrail(?: m)?(?: license)?"),
    "proprietary": (r"all rights reserved", r"confidential and proprietary", r"may not be reproduced without(?: prior)?(?: written)? permission"),
    "public-domain": (r"(?:is|are) in the public domain", r"dedicated to the public domain", r"released into the public domain"),
}
# Texts of licenses, by their telling sentences.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit": (
        r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "bsd": (
        r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        r"redistributions of source code must retain the above copyright notice",
        r"redistributions in binary form must reproduce the above copyright notice",
    ),
    "bsd-3-clause": (r"neither the name of .{1,80}? may be used to endorse or promote products derived from this software",),
    "bsd-4-clause": (r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e?)ment",),
    "isc": (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "zlib": (r"this software is provided as is without any express or implied warranty in no event will the authors be held liable",),
    "gpl": (
        r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        r"you should have received a copy of the gnu general public license along with this program",
    ),
    "lgpl": (r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",),
    "agpl-3.0": (r"under the terms of the gnu affero general public license as published by the free software foundation",),
    "apache-2.0": (
        r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    "mpl-2.0": (r"this source code form is subject to the terms of the mozilla public license v 2 0",),
    "bsl-1.0": (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",),
    "cc0-1.0": (r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights",),
}
# Wordings around a name: (before, after, priority, confidence).
WORDINGS = (
    (r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?", "", 30, 0.95),
    (r"spdx license identifier ", r"(?: only| or later)?", 30, 1.0),
    (r"license ", "", 20, 0.8),
    ("", "", 10, 0.7),
)


def _keywords(pattern: str) -> frozenset[str]:
    """Words that every match of the pattern holds: those outside groups and options."""
    text = pattern
    while (inner := re.search(r"\(\?:([^()]*)\)\??", text)) is not None:
        # A group that begins with a space leaves the word before it whole.
        text = text[: inner.start()] + ("" if re.match(r" (?!\?)", inner[1]) else "\0") + text[inner.end() :]
    # Words around an optional space may be one word.
    text = re.sub(r"\S+(?: \?\S*)+", " ", text)
    # A word touched by an option, a class or a repeat is not certain.
    text = re.sub(r"\S*[\0?\[\]{}.*+|\\]\S*", " ", text)
    return frozenset(w for w in text.split() if len(w) > 1)


def rules() -> list[Rule]:
    """The ordered rules: telling sentences, then each name in each wording."""
    out = []
    for label, patterns in SENTENCES.items():
        for p in patterns:
            out.append(Rule(label, 40, 1.0, _keywords(p), re.compile(f"(?<![^ ]){p}(?![^ ])")))
    for label, names in NAMES.items():
        for name in names:
            for before, after, priority, confidence in WORDINGS:
                out.append(Rule(label, priority, confidence, _keywords(name), re.compile(f"(?<![^ ]){before}{name}{after}(?![^ ])")))
    # Identifiers of file headers are the labels themselves.
    for label in NAMES.keys() - {"proprietary", "public-domain"}:
        name = "spdx license identifier " + re.sub(r"[-.]", " ", label) + r"(?: only| or later)?"
        out.append(Rule(label, 30, 1.0, _keywords(name), re.compile(f"(?<![^ ]){name}(?![^ ])")))
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


class Detection(NamedTuple):
    label: str
    start: int  # characters of the normalised text
    end: int
    priority: int
    confidence: float


def suppressed(found: list[Detection]) -> list[Detection]:
    """Detections that stay: by priority, then length, then place; none within a kept interval,
    none that overlaps a kept one of higher priority. One sweep per priority."""
    kept: list[Detection] = []
    covered: list[tuple[int, int]] = []  # disjoint stretches of higher priorities, in order
    in_order = sorted(found, key=lambda d: (-d.priority, d.start, -d.end, d.label))
    for _, group in itertools.groupby(in_order, key=lambda d: d.priority):
        own, reach, at = [], -1, 0
        for d in group:
            while at < len(covered) and covered[at][1] <= d.start:
                at += 1
            beaten = at < len(covered) and covered[at][0] < d.end
            # What begins no later and reaches as far holds this one.
            if not beaten and d.end > reach:
                reach = d.end
                own.append(d)
        kept += own
        merged: list[tuple[int, int]] = []
        for start, end in sorted(covered + [(d.start, d.end) for d in own]):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        covered = merged
    return sorted(kept, key=lambda d: d.start)


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.by_keyword: dict[bytes, list[int]] = {}
        self.always: list[int] = []
        # A rule waits for its longest keyword; the others are tested then.
        for i, rule in enumerate(self.rules):
            if rule.keywords:
                self.by_keyword.setdefault(max(rule.keywords, key=lambda w: (len(w), w)).encode(), []).append(i)
            else:
                self.always.append(i)
        self.needed = [frozenset(w.encode() for w in r.keywords) for r in self.rules]
        self.phrases = [(f" {p} ".encode(), frozenset(p.encode().split()), label) for p, label in BASE.items()]

    def scan(self, text: str | None) -> tuple:
        """(n_words, base places as word numbers, base labels, detections, score)."""
        words = words_of(text)
        have = set(words)
        places: list[int] = []
        base = set()
        line = b""
        for phrase, need, label in self.phrases:
            if need <= have:
                line = line or b" " + b" ".join(words) + b" "
                at = line.find(phrase)
                before = word = 0
                while at >= 0:
                    word += line.count(b" ", before, at)
                    before = at
                    places.append(word)
                    base.add(label)
                    at = line.find(phrase, at + 1)
        chosen = sorted(
            i for w in have & self.by_keyword.keys() for i in self.by_keyword[w] if self.needed[i] <= have
        ) + self.always
        found = []
        if chosen:
            normal = b" ".join(words).decode()
            for i in chosen:
                rule = self.rules[i]
                found += [Detection(rule.label, m.start(), m.end(), rule.priority, rule.confidence) for m in rule.pattern.finditer(normal)]
        kept = suppressed(found)
        score = max([d.confidence for d in kept] + [0.6 * bool(base)])
        return len(words), places, base, kept, score


SCAN = (
    "doc_id long, n_words long, places array<long>, base_labels array<string>, "
    "detections array<struct<label:string,start:long,end:long,priority:int,confidence:double>>, "
    "labels array<string>, score double"
)


def scan(docs: DataFrame) -> DataFrame:
    """For every document: ``n_words``, base ``places``, labels, ``detections`` in the
    normalised text, and ``score``, the greatest confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        detection = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [scanner.scan(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([sorted(r[1]) for r in rows], pa.list_(pa.int64())),
                        pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                        pa.array([[d._asdict() for d in r[3]] for r in rows], pa.list_(detection)),
                        pa.array([sorted(r[2] | {d.label for d in r[3]}) for r in rows], pa.list_(pa.string())),
                        pa.array([r[4] for r in rows], pa.float64()),
                    ],
                    names=["doc_id", "n_words", "places", "base_labels", "detections", "labels", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCAN)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
