import random
import re
import time

from gazetide.llm import licenses
from gazetide.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    "MIT License, mit-license; MIT  LICENSE mit licenses",
    "cc by cc by, CC-BY 4.0 ccby cc byé cc by",
    "GNU General Public License GNU GENERAL PUBLIC LICENSE version 3",
    "ÀPACHE license apache\nlicense 2.0" * 50,
    "Licensed under the Apache License, Version 2.0.",
    "word " * 50_000 + "apache license",
]


def test_base_of_made_texts(spark):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels int")
    got = licenses.digest(licenses.scan(df)).orderBy("doc_id").collect()
    for text, r in zip(TEXTS, got):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(df.where("false")).collect() == []


def test_rules():
    rules = licenses.rules()
    assert len(rules) > 300
    scanner = licenses.Scanner()
    assert not scanner.always

    def labels(text):
        return {d.label for d in scanner.scan(text)[3]}

    assert labels("Released under the terms of the GNU General Public License version 3") == {"gpl-3.0"}
    assert labels("SPDX-License-Identifier: GPL-2.0-only") == {"gpl-2.0"}
    assert labels("Licensed under CC BY-NC-SA 4.0") == {"cc-by-nc-sa-4.0"}
    assert labels("nothing to see") == set()


def test_keywords_are_needed():
    # A pattern that holds a keyword only in an option would match without it.
    for rule in licenses.rules():
        plain = re.sub(r"\(\?<?[!=][^()]*\)", "", rule.pattern.pattern)
        while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", plain)) != plain:
            plain = shorter
        assert all(w in plain for w in rule.keywords), rule


def matches(parsed):
    """Texts that a parsed pattern matches: every branch, every option with and without."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            of = [chr(arg)]
        elif name == "ANY":
            of = ["x"]
        elif name == "IN":
            of = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif name == "BRANCH":
            of = [m for b in arg[1] for m in matches(b)]
        elif name == "SUBPATTERN":
            of = matches(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            of = [m * n for n in {least, min(most, least + 1)} for m in matches(inner)]
        else:
            assert name == "ASSERT_NOT", name
            continue
        out = [a + b for a in out for b in dict.fromkeys(of)]
    return out


def test_every_match_passes_the_keywords():
    for rule in licenses.rules():
        for text in matches(re._parser.parse(rule.pattern.pattern)):
            assert rule.pattern.fullmatch(text), (rule, text)
            assert rule.keywords <= set(text.split()), (rule, text)


def test_joined_names():
    scanner = licenses.Scanner()
    for name, label in (
        ("Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
        ("Attribution-Share Alike 3.0", "cc-by-sa-3.0"),
        ("Attribution-NoDerivatives 4.0", "cc-by-nd-4.0"),
        ("Attribution-NonCommercial 4.0", "cc-by-nc-4.0"),
        ("Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa-4.0"),
        ("Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd-4.0"),
    ):
        _, _, _, found, score = scanner.scan(f"Creative Commons {name}")
        assert [d.label for d in found] == [label] and score == 0.7, name


def test_suppression():
    d = licenses.Detection
    kept = licenses.suppressed([d("a", 0, 30, 10, 0.5), d("b", 5, 20, 30, 0.9), d("c", 6, 12, 20, 0.8), d("e", 40, 50, 10, 0.5), d("f", 40, 50, 10, 0.5)])
    assert [k.label for k in kept] == ["b", "e"]


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_licenses"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def slowly_suppressed(found):
    kept = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        inside = any(k.start <= d.start and d.end <= k.end for k in kept)
        beaten = any(k.start < d.end and d.start < k.end and k.priority > d.priority for k in kept)
        if not inside and not beaten:
            kept.append(d)
    return sorted(kept, key=lambda d: d.start)


def test_sweep_equals_comparing_all():
    rng = random.Random(5)
    for _ in range(400):
        found = [licenses.Detection(rng.choice("abc"), at, at + rng.randint(1, 12), 10 * rng.randint(1, 3), 0.5) for at in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))]
        assert licenses.suppressed(found) == slowly_suppressed(found)


def test_very_many_detections_take_linear_time():
    began = time.monotonic()
    n, places, _, found, _ = licenses.Scanner().scan("the MIT License. " * 60_000)
    assert n == 180_000 and len(found) == 60_000 and places == list(range(1, 180_000, 3))
    assert time.monotonic() - began < 20


def test_identifiers_and_short_names():
    scanner = licenses.Scanner()
    for text, label in (
        ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
        ("the 3-clause BSD license", "bsd-3-clause"), ("licensed under GPL", "gpl"), ("the Artistic License", "artistic"),
    ):
        assert label in [d.label for d in scanner.scan(text)[3]], text
