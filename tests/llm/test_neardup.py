import random

from gazetide.llm import neardup
from gazetide.llm.components import connected_components


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4):
    of = [(i, sets(t, k)) for i, t in rows]
    parent = list(range(len(of)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, s) in enumerate(of):
        for y, (j, t) in enumerate(of[:x]):
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[max(top(x), top(y))] = min(top(x), top(y))
    least = {}
    for x, (i, _) in enumerate(of):
        least[top(x)] = min(least.get(top(x), i), i) if i is not None else None
    return sorted((str(i), len(s), str(least[top(x)]), i is None or i == least[top(x)]) for x, (i, s) in enumerate(of))


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, keys string, id int")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(df, k=4, **more).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "TILE", 8)
    rng = random.Random(3)
    rows = [(900, None), (901, ""), (902, " \n\t"), (None, "a b c d e"), (None, "a b c d e"), (903, "One two"), (904, "one TWO"), (905, "one two three")]
    base = [f"b{i}" for i in range(120)]
    rows += [(i, edited(base, rng.randrange(0, 9), rng)) for i in range(60)]
    rows += [(100 + i, " ".join(f"x{rng.randrange(40)}" for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    rows += [(200 + i, rows[20][1]) for i in range(15)] + [(300, "ÀÉ b c d É"), (301, "àÉ b c d É")]
    # A chain: neighbours are linked, its ends are not.
    rows += [(400 + i, " ".join(f"c{j}" for j in range(3 * i, 3 * i + 60))) for i in range(12)]
    assert result(spark, rows) == brute(rows)


def test_empty_and_filter(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []
    rows = [(2, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (3, None), (None, "a b c d e f g"), (4, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, __x string")
    kept = neardup.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id + 1 as a", "id as b")
    got = connected_components(links).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    one = rng.integers(0, 2**63, 1, dtype=np.uint64)
    assert neardup.sketch(one, 128).max() != neardup.MASK
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)))
    agree = np.mean(neardup.sketch(a, 512) == neardup.sketch(b, 512))
    assert abs(agree - 0.8) < 0.1


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    x, y = "a b c d e f g", "other words that are alone here now"
    rows = [(5, x), (5, y), (1, x), (6, y + " z"), (7, "p q r s t u"), (7, "P Q R s t u"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = neardup.without_near_duplicates(df, k=4, percent=80)
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()))
    assert got == [(1, x), (5, y), (7, ""), (7, "p q r s t u")]


def test_bitmap_drops_only_other_documents(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text")
    wanted = docs.where("doc_id % 7 = 0").selectExpr("doc_id", "doc_id + 1 as more")
    for bits in (64, 1 << 12, 1 << 20):
        monkeypatch.setattr(neardup, "BITMAP", bits)
        got = {(r.doc_id, r.text, r.more) for r in neardup.texts_of(docs, wanted).collect()}
        assert got == {(i, f"t{i}", i + 1) for i in range(0, 3000, 7)}
