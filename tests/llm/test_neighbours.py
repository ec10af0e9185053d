import math
import random

from pyspark.sql import functions as F

from gazetide.llm import neighbours


def brute(rows, k):
    ok, seen = {}, {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v), key=lambda r: (r[0], [x if x is not None and x == x else 0 for x in r[1]])):
        if all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, v)
    out = []
    for q, v in ok.items():
        if q % 5 == 0:
            scored = []
            for c, w in ok.items():
                if c != q and len(w) == len(v):
                    dot = sum(a * b for a, b in zip(v, w))
                    scored.append((-max(-1.0, min(1.0, dot / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)))), c))
            out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vec = lambda d=6: [float(rng.randint(-4, 4)) for _ in range(d)]
    rows = [(i, vec()) for i in range(120)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(40)]
    rows += [(300, None), (305, []), (310, [0.0] * 6), (315, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (320, [float("nan")] * 6)]
    rows += [(325, [float("inf")] + [1.0] * 5), (330, vec(4)), (331, vec(4)), (335, [3.0]), (None, vec()), (10, rows[10][1]), (15, vec())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, i int, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, k=5, query_block=8, block=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)
    assert neighbours.nearest(df.where("false"), F.lit(True)).collect() == []


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(50, 1500)), rng.normal(size=(60, 1500))))
    (ca, sa, la), (cb, sb, lb) = neighbours.quantised(a), neighbours.quantised(b)
    near = neighbours.integer_product(ca, cb) * sa[:, None] * sb[None, :]
    assert (np.abs(near - a @ b.T) <= la[:, None] + (1 + la[:, None]) * lb[None, :] + 1e-9).all()
    assert (neighbours.integer_product(ca, cb) == ca.astype(np.int64) @ cb.astype(np.int64).T).all()
