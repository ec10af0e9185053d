import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from gazetide.llm import mixing

SCHEMA = "doc_id long, source string, text string, copies string, `__key` int"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, still, goal = Fraction(sum(sizes.values())), list(order), {}
    while still:
        share = {s: left * weight[s] / sum(weight[x] for x in still) for s in still}
        full = [s for s in still if share[s] > most * sizes[s]]
        if not full:
            return goal | share
        goal |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(goal[s] for s in full)
        still = [s for s in still if s not in full]
    return goal


def brute(rows, most=3):
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    goals, want = brute_targets(sizes, most=most), []
    for source, total in sizes.items():
        shift = int(hashlib.md5(f"mix:{source or ''}".encode()).hexdigest()[:8], 16)
        step = int(goals[source] / total * mixing.ONE) if total else 0
        for k, (n, i) in enumerate(sorted((size(t), i) for i, s, t in rows if s == source)):
            copies = ((k + 1) * step + shift) // mixing.ONE - (k * step + shift) // mixing.ONE
            want.append((i, n, total, float(goals[source]), copies * n))
    return sorted(want)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 20 + ["b", "é", "Z", None, "tiny"]) if i > 5 else "tiny"
        n = 0 if source == "tiny" and i > 2 else int(rng.paretovariate(0.8)) % 400
        rows.append((i, source, None if rng.random() < 0.02 else " \t\x0b".join(["w\xa0x"] * n)))
    rows += [(1000 + i, "empty", "" if i else None) for i in range(3)]
    have = sorted(tuple(r) for r in mixing.digest(mixing.mixed(made(spark, rows))).collect())
    want = brute(rows)
    assert [r[:3] + r[4:] for r in have] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * b[3] for a, b in zip(have, want))
    again = sorted(tuple(r) for r in mixing.digest(mixing.mixed(made(spark, rows, 7))).collect())
    assert again == have
    source_of = {i: s for i, s, _ in rows}
    for source in set(source_of.values()):
        mine = [r for r in have if source_of[r[0]] == source]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= max(r[1] for r in mine)
        assert all(r[4] <= 3 * r[1] for r in mine)


def test_caps_hold_and_the_excess_is_shared_again(spark):
    # The last two fill up one after the other; the first takes what is left.
    sizes = {"a": 1000, "b": 90, "c": 100}
    goals = brute_targets(sizes)
    assert goals["b"] == 270 and goals["c"] == 300
    rows = [(i, s, "w " * 10) for s, n in sizes.items() for i in range(n // 10)]
    got = {r.source: r.target for r in mixing.targets(mixing.sized(made(spark, rows))).collect()}
    assert got == {s: float(g) for s, g in goals.items()}
    taken = mixing.mixed(made(spark, rows)).groupBy("source").agg(F.min("copies"), F.max("copies")).collect()
    assert {r[0]: (r[1], r[2]) for r in taken if r[0] != "a"} == {"b": (3, 3), "c": (3, 3)}


def test_documents_come_out_as_often_as_they_are_taken(spark):
    rows = [(i % 40, "s" if i % 2 else None, f"text {i % 80} " * (i % 7)) for i in range(200)]
    rows += [(None, "s", "no id"), (None, "s", "no id"), (7, "s", None)]
    docs = made(spark, rows)
    decisions = mixing.mixed(docs)
    out = mixing.emitted(docs, decisions)
    assert set(out.columns) == set(docs.columns) | {"copy"}
    assert out.count() == decisions.agg(F.sum("copies")).first()[0]
    assert out.where("copies <> 'x' or `__key` <> 1").isEmpty()


def test_empty_table(spark):
    docs = made(spark, []).where("false")
    assert mixing.digest(mixing.mixed(docs)).collect() == []
    assert mixing.emitted(docs, mixing.mixed(docs)).collect() == []
