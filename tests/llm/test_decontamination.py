import random
import re

from gazetide.llm import decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, passage in items:
            p = words(passage) if item is not None else []
            n = min(window, len(p))
            for at in range(len(p) - n + 1) if p else ():
                for d in range(len(w) - n + 1):
                    if w[d : d + n] == p[at : at + n]:
                        hit.update(range(d, d + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def tables(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "ß"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(13, 40))) for i in range(12)] + [(20, "Two Words"), (21, None), (22, ""), (None, text(15)), (0, text(14)), (23, "v1 v2 v3")]
    docs = [(0, None), (1, ""), (2, "two words two words two"), (3, items[3][1] + " " + items[3][1]), (None, items[4][1])]
    docs += [(10 + i, f"{text(rng.randint(0, 50))} x {items[rng.randrange(12)][1][:120]}, {text(20)}.") for i in range(40)] + [(10, "x")]
    docs += [(99, "word " * 3000 + items[5][1].upper())]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, spans string")
    return docs, items, df, bench


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 200)
    docs, items, df, bench = tables(spark)
    for block_words in (2_000_000, 100):
        got = decontamination.matches(df, bench, block_words=block_words).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in got), key=repr) == brute(docs, items)
    long = next(r for r in got if r.doc_id == 99)
    assert any(s.start == 3000 and s.length == len(words(items[5][1])) and s.item_start == 0 for s in long.spans)


def test_filter_and_empty_tables(spark):
    docs, items, df, bench = tables(spark)
    kept = decontamination.without_contaminated(df, bench)
    assert kept.columns == df.columns
    # Every row by its own text: id 10 is there with a clean text as well.
    judged = [(row, brute([row], items)[0]) for row in docs]
    clean = [row for row, (_, n, h, _) in judged if not (h and 20 * h >= n)]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, clean))
    assert decontamination.without_contaminated(df, bench.where("false")).count() == len(docs)
    assert decontamination.matches(df.where("false"), bench).collect() == []


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, passage, "a"), (1, "clean words", "b"), (None, passage, "c"), (None, "clean too", "d"), (2, None, "e")],
        "doc_id long, text string, __key string",
    )
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontamination.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["__key"] for r in kept.collect()) == ["b", "d", "e"]
