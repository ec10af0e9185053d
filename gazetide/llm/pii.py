"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans. Labelers vote on each (yes, no or silent): the shape of the text, a
gazetteer, a checksum, the words before it, and whether it stands alone. Silence
is no evidence. Only the counts of vote patterns leave the rows, at most ``3 ** 5`` per kind. Expectation-maximisation over those counts
estimates how reliable each labeler is; the labels it infers train a logistic span classifier
whose weights are literals in the plan that scores the spans.

The fixed patterns (``BASE``) decide on their own: what they find stays, with its probability.
Wider patterns (``WIDER``) catch what the fixed ones merge or miss, such as a number glued to the
next one; the classifier decides about these.

Places come from the matches and the lengths of what lies between them, so a text is read by
each pattern twice, and only where a cheap test says that it may match. All patterns stay within
a line.

Defined results: null and empty texts have no spans. Offsets count code points, the end is
exclusive. Rows that repeat a document are judged each; a null id stays null. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetide.functions.exprs import let

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "person")

# The patterns of the base spans, in the order of KINDS. A match may start only
# where a run begins or the previous match ended, which changes no match and avoids
# trying every character of a run.
BASE = {
    "email": (
        "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    ),
    "ip": (".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDER = {
    # Every match holds one of these, whatever stands before "at".
    "email": (("at)", "at]", "at )", "at ]"), r"[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"),
    "card": ("", r"(?<![0-9.])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9.])"),
    "phone": ("(", r"(?<![0-9+])\+?[0-9]{0,3} ?\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "person": (". ", r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra)\. \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"),
}
DIGITS_FIRST = ("ip", "card", "ssn", "iban")

GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|us)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+?(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])?[ .-]?\(?[2-9]",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|SE|SI|SK)",
    "person": r"(?i)\b(anna|carlos|david|elena|emma|hans|james|jean|john|jose|karl|laura|maria|marie|mark|michael|paul|peter|pierre|robert|sarah|thomas)\b",
}
CONTEXT = {
    "email": r"(?i)(e-?mail|contact|write|reach|mailto|correo|courriel)",
    "ip": r"(?i)(\bip\b|address|host|server|login|client|adresse)",
    "card": r"(?i)(card|visa|master|amex|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|\btel\b|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)",
    "ssn": r"(?i)(ssn|social security)",
    "iban": r"(?i)(iban|account|konto|compte|cuenta|bank)",
    "person": r"(?i)(name|dear|signed|contact|sincerely|regards)",
}
LABELERS = ("shape", "gazetteer", "checksum", "context", "alone")


def _places(text: Column, gate: str | tuple[str, ...], pattern: str, digits: bool) -> Column:
    """Matches of ``pattern`` and the stretches around them, where the text may match: it holds
    one of ``gate``."""
    wanted = functools.reduce(Column.__or__, (text.contains(g) for g in ([gate] if isinstance(gate, str) else gate)))
    if digits:
        wanted = wanted & text.rlike("[0-9][ 0-9.-]{4}")
    return F.when(
        wanted,
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
            F.transform(
                F.split(text, pattern, -1),
                lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(40)).alias("tail"), F.left(g, F.lit(1)).alias("head")),
            ).alias("around"),
        ),
    )


BLOCK = 256


def _running(numbers: Column) -> Column:
    """Sums of all earlier elements, for every element; work stays near linear by blocks."""
    zero = F.lit(0)
    plus = lambda total, x: total + x

    def of(all_: Column) -> Column:
        sums = F.transform(
            F.sequence(zero, F.greatest(F.floor((F.size(all_) - 1) / BLOCK).cast("int"), zero)),
            lambda b: F.aggregate(F.slice(all_, b * BLOCK + 1, BLOCK), zero, plus),
        )
        return let(
            sums,
            lambda done: F.transform(
                all_,
                lambda x, i: F.aggregate(F.slice(done, 1, F.floor(i / BLOCK).cast("int")), zero, plus)
                + F.aggregate(F.slice(all_, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), zero, plus),
            ),
        )

    return let(numbers, of)


def _spans(places: Column, starts: Column, kind: str, base: bool) -> Column:
    """array<struct<kind, start, end, match, before, after, base>>."""
    one = lambda m, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        (F.get(starts, i) + F.get(places["around"], i)["n"]).alias("start"),
        (F.get(starts, i) + F.get(places["around"], i)["n"] + F.length(m)).alias("end"),
        m.alias("match"),
        F.get(places["around"], i)["tail"].alias("before"),
        F.get(places["around"], i + 1)["head"].alias("after"),
        F.lit(base).alias("base"),
    )
    return F.coalesce(F.transform(places["found"], one), F.array())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _small(part: Column) -> Column:
    number = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))


def _iban_rest(text: Column) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    letter = lambda c: F.ascii(c) - 55
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda rest, c: F.when(c == "", rest)
        .when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97)
        .otherwise((rest * 100 + letter(c)) % 97),
    )


def _valid(kind: int, match: Column) -> Column:
    """The checks that a match must pass."""
    digits = _digits(match)
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(match, r"\."), _small),
        "card": n.between(13, 19) & F.call_function("luhn_check", digits),
        "phone": n.between(9, 15),
        "ssn": F.lit(True),
        "iban": _iban_rest(match) == 1,
        "person": F.lit(True),
    }[KINDS[kind]]


def _by_kind(kind: Column, of) -> Column:
    """``of(number of the kind)`` for the kind of the row."""
    out = None
    for i in range(len(KINDS)):
        out = (F.when if out is None else out.when)(kind == i, of(i))
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _code(span: Column) -> Column:
    """The votes of all labelers as one number in base 3: 0 no, 1 silent, 2 yes."""
    kind, match = span["kind"], span["match"]
    known = _by_kind(kind, lambda i: match.rlike(GAZETTEER[KINDS[i]]))
    valid = _by_kind(kind, lambda i: _valid(i, match))
    checked = kind.isin(*(KINDS.index(k) for k in ("ip", "card", "phone", "iban")))
    near = _by_kind(kind, lambda i: span["before"].rlike(CONTEXT[KINDS[i]]))
    closed = span["before"].rlike(r"[\p{L}0-9]$") | F.coalesce(span["after"].rlike(r"[\p{L}0-9]"), F.lit(False))
    of_other = span["before"].rlike(r"(?i)(order|invoice|version|isbn|part|serial)\W*$")
    votes = (
        _vote(F.length(match).between(5, 60), F.length(match) > 60),
        _vote(known, ~known & (kind != KINDS.index("person"))),
        _vote(checked & valid, checked & ~valid),
        _vote(near, of_other),
        _vote(~closed, closed),
    )
    return sum((v * 3**i for i, v in enumerate(votes)), F.lit(0)).cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__spans``: array<struct<kind, start, end, base, code>>, the valid base
    spans first, then wider ones that overlap no base span of their kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sets = [(k, True, *BASE[k]) for k in BASE] + [(k, False, *WIDER[k]) for k in WIDER]
    names = [f"__p{i}" for i in range(len(sets))]
    columns = docs.columns
    found = docs.select(*columns, *(_places(text, gate, pattern, k in DIGITS_FIRST).alias(n) for n, (k, _, gate, pattern) in zip(names, sets)))

    def moved(places: Column) -> Column:
        """Where each stretch begins: what lies before it."""
        return _running(
            F.transform(
                places["found"], lambda m, i: F.get(places["around"], i)["n"] + F.length(m)
            )
        )

    placed = found.select(*columns, *names, *(F.when(F.size(F.col(n)["found"]) > 0, moved(F.col(n))).alias(f"{n}s") for n in names))
    spans = {
        b: F.concat(*(_spans(F.col(n), F.col(f"{n}s"), k, b) for n, (k, is_base, _, _) in zip(names, sets) if is_base == b))
        for b in (True, False)
    }
    passing = lambda s: _by_kind(s["kind"], lambda i: _valid(i, s["match"]))
    both = placed.select(
        *columns,
        F.filter(spans[True], passing).alias("__base"),
        F.filter(spans[False], passing).alias("__wide"),
    )
    free = F.filter(
        "__wide",
        lambda w: ~F.exists("__base", lambda b: (b["kind"] == w["kind"]) & (b["start"] < w["end"]) & (w["start"] < b["end"])),
    )
    with_code = lambda s: F.struct(s["kind"], s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), _code(s).alias("code"))
    return both.select(*columns, F.transform(F.concat("__base", free), lambda s: with_code(s)).alias("__spans"))


def _votes(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELERS))]


def span_classifier(counts: dict[tuple[int, int], int], rounds: int = 60) -> dict[tuple[int, int], float]:
    """(kind, votes) -> probability that a span is personal data. ``counts``: spans by kind and
    votes, at most ``3 ** 5`` patterns a kind."""
    cells = [(kind, _votes(code), n) for (kind, code), n in sorted(counts.items())]
    # Expectation-maximisation over the votes that are not silent. Start: labelers are right more
    # often than not. right[j][y][v // 2]: how often labeler j votes v on class y.
    right = [[[0.3, 0.7] if y else [0.7, 0.3] for y in (0, 1)] for _ in LABELERS]
    share = [0.5] * len(KINDS)
    posterior = [0.5] * len(cells)
    for _ in range(rounds):
        for c, (kind, votes, _) in enumerate(cells):
            odds = math.log(share[kind] / (1 - share[kind]))
            odds += sum(math.log(right[j][1][v // 2] / right[j][0][v // 2]) for j, v in enumerate(votes) if v != 1)
            posterior[c] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for j in range(len(LABELERS)):
            for y in (0, 1):
                # A few imagined votes keep the start's direction where data are few.
                have = [5 * x for x in ([0.3, 0.7] if y else [0.7, 0.3])]
                for c, (_, votes, n) in enumerate(cells):
                    if votes[j] != 1:
                        have[votes[j] // 2] += n * (posterior[c] if y else 1 - posterior[c])
                right[j][y] = [x / sum(have) for x in have]
        for kind in range(len(KINDS)):
            own = [(posterior[c], n) for c, (k, _, n) in enumerate(cells) if k == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
    # The span classifier: logistic regression on votes and kind against the inferred labels.
    size = len(KINDS) + 3 * len(LABELERS)
    weights = [0.0] * size
    rows = [([kind, *(len(KINDS) + 3 * j + v for j, v in enumerate(votes) if v != 1)], n) for kind, votes, n in cells]
    total = sum(n for _, n in rows) or 1

    def chance(at: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(weights[i] for i in at)))))

    for _ in range(400):
        slope = [1e-4 * w for w in weights]
        for (at, n), p in zip(rows, posterior):
            error = n / total * (chance(at) - p)
            for i in at:
                slope[i] += error
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    everything = itertools.product(range(len(KINDS)), range(3 ** len(LABELERS)))
    return {
        (kind, code): chance([kind, *(len(KINDS) + 3 * j + v for j, v in enumerate(_votes(code)) if v != 1)])
        for kind, code in everything
    }


def learned(spans: DataFrame) -> dict[tuple[int, int], float]:
    """The classifier, from the vote patterns of all spans of the table ``candidates`` gives."""
    # An outer explode: the filter that is inferred for the other would make the spans twice.
    cells = (
        spans.select(F.explode_outer("__spans").alias("s"))
        .where(F.col("s").isNotNull())
        .groupBy(F.col("s")["kind"].alias("kind"), F.col("s")["code"].alias("code"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    return span_classifier({(r.kind, r.code): r.n for r in cells})


def decided(spans: DataFrame, chances: dict[tuple[int, int], float], least: float = 0.5) -> DataFrame:
    """``__spans`` of candidates that are kept, by kind and place, with ``chance``."""
    n = 3 ** len(LABELERS)
    cells = ",".join(f"{chances[(k, c)]:.6f}D" for k in range(len(KINDS)) for c in range(n))
    table = F.expr(f"array({cells})")
    chance = lambda s: F.get(table, s["kind"] * n + s["code"])
    kept = F.filter("__spans", lambda s: s["base"] | (chance(s) >= least))
    return spans.withColumn(
        "__spans",
        F.array_sort(
            F.transform(
                kept,
                lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), chance(s).alias("chance")),
            )
        ),
    )


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(kept: DataFrame) -> DataFrame:
    of_base = F.filter("__spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("__spans", lambda s: s["base"] & (s["kind"] == KINDS.index(k)))).cast("long")
    return kept.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(named(of_base).cast("binary"), 256).alias("base_sha256"),
        named(F.col("__spans")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, where there is
    such a column, counts the new text. Overlapping spans become one, under the first's name."""
    spans = candidates(docs)
    kept = decided(spans, learned(spans))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    in_place = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        in_place,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda have, s: F.struct(
            F.when(s["start"] >= have["at"], F.concat(have["out"], F.substring(F.col("text"), have["at"] + 1, s["start"] - have["at"]), F.get(names, s["kind"])))
            .otherwise(have["out"]).alias("out"),
            F.greatest(s["end"], have["at"]).alias("at"),
        ),
        lambda have: F.concat(have["out"], F.substring(F.col("text"), have["at"] + 1, F.length("text"))),
    )
    out = kept.withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
