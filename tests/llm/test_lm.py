import math
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gazetide.llm import lm
from gazetide.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def against(rows, texts):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in texts for w in tokens(t) if not held(i))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (
            (str(i), held(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
            for i, t in texts
        )
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_query_against_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    scored = QUERIES["op8_language_model"](spark, SF).cache()
    against(scored.collect(), texts)
    held = {r.held_out: r for r in lm.perplexity(scored).collect()}
    assert held[True].perplexity < held[True].base_perplexity


def test_odd_rows(spark):
    texts = [(0, None), (1, ""), (2, "One one ONE\ttwo"), (2, "One one ONE\ttwo"), (None, "É é two"), (4, "w " * 30_000)]
    path = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, shard int")
    against(lm.scores(path).collect(), texts)
    assert lm.scores(path.where("false")).collect() == []
    alone = path.where("doc_id = 1")
    assert len(lm.scores(alone, folds=1, held=0).collect()) == 1


def test_letters_are_a_distribution():
    words = pa.array([b"", b"ab", b"abc", b"b", b"\xc3\xa9"], pa.binary())
    codes, begins = lm.symbols_of(words)
    assert begins.tolist() == [0, 1, 4, 8, 10] and codes[0] == (257 * 258 + 257) * 258 + 256
    cells, at = np.unique(codes, return_inverse=True)
    spelling = lm.Spelling(cells, np.bincount(at) * 3.0, 1)
    for two, one in ((257, 257), (257, 97), (97, 98), (1, 2)):
        context = two * 258 + one
        p = spelling.back2[context] * spelling.p1[one, :257]
        own = spelling.codes // 258 == context
        p[spelling.codes[own] % 258] += spelling.own[own]
        assert abs(p.sum() - 1) < 1e-9


def test_seats():
    counts = np.array([0.0, 1, 2, 50, 5000, 2_000_000])
    t = lm.seated(counts, np.full(6, 0.01), 0.7, 1.0, 100.0, 3, np.arange(6, dtype=np.uint64))
    assert t[0] == 0 and t[1] == 1 and (t[1:] >= 1).all() and (t <= counts).all()
    assert t[5] > t[4] > t[3]
    assert (t == lm.seated(counts, np.full(6, 0.01), 0.7, 1.0, 100.0, 3, np.arange(6, dtype=np.uint64))).all()


def test_order_of_words_counts(spark):
    texts = [(i, "red fox runs over green hills today") for i in range(60)] + [(100 + i, "hills green over runs fox red today") for i in range(2)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    df.write.parquet(path := f"{tempfile.mkdtemp(prefix='run-')}/docs")
    got = {r.doc_id: r for r in lm.scores(spark.read.parquet(path)).collect()}
    assert abs(got[0].base_score - got[100].base_score) < 1e-9
    assert got[0].score > got[100].score + 1


def test_pair_counts_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:40] + [None, "", "a b a b"]
    rows = [(i % 3, i, i % 5 == 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "shard int, doc_id long, held_out boolean, text string").repartition(3, "shard")
    docs = df.withColumn("shard", F.spark_partition_id()).cache()
    counts = Counter(
        pair for r in docs.where("not held_out").collect() for w in [tokens(r.text)] for pair in zip([b"", *w], w)
    )
    answers = lm.merged_pairs(lm.shard_pairs(docs, 4)).collect()
    assert sum(r.once for r in answers if r.shard is None) == sum(c == 1 for c in counts.values())
    assert sum(int(lm.unpacked(r.counts).sum()) for r in answers if r.shard is None) == len(counts)
    vocabulary = sorted({w for t in texts for w in tokens(t)})
    got = lm.with_customers(spark.createDataFrame([(bytearray(w), 1) for w in vocabulary], "word binary, c long"), spark.createDataFrame(answers, lm.PAIR_ANSWERS)).collect()
    before = Counter(w for _, w in counts)
    assert {bytes(r.word): r.k for r in got} == {w: max(1, before[w]) for w in vocabulary}


def test_seats_in_word_contexts_are_sampled(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60] + ["a b a b a c"] * 30
    rows = [(i % 3, i, False, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "shard int, doc_id long, held_out boolean, text string").repartition(3, "shard")
    docs = docs.withColumn("shard", F.spark_partition_id()).cache()
    counts = Counter(pair for t in texts for w in [tokens(t)] for pair in zip([b"", *w], w))
    c = Counter(w for t in texts for w in tokens(t))
    answers = lm.merged_pairs(lm.shard_pairs(docs, 4)).cache()
    words = spark.createDataFrame([(bytearray(w), n) for w, n in c.items()], "word binary, c long")
    first = lm.with_tables(lm.with_customers(words, answers), answers)
    followers = Counter(before for before, _ in counts)
    assert {bytes(r.word): r.trail for r in first.collect()} == {w: [float(followers[w])] for w in c}
    total = sum(c.values())
    known = first.withColumn("log10p", F.log10(F.col("c") / total))
    got = {bytes(r.word): r for r in lm.swept(known, answers, 0.7, 5).collect()}
    assert set(got) == set(c)
    # Every table is one customer of the word restaurant; no more tables than customers.
    assert sum(r.k for r in got.values()) == sum(r.trail[-1] for r in got.values())
    assert sum(r.k for r in got.values()) > len(counts)
    contexts = Counter(w for _, w in counts)
    assert all(contexts[w] <= r.k <= c[w] for w, r in got.items())
    assert all(followers[w] <= r.trail[2] <= c[w] for w, r in got.items())
    # Who redraws the seats of a context gets its tables.
    keys = {w: k for w, k in zip(c, (lm.word_keys(pa.array(list(c), pa.binary())) >> np.uint64(16)))}
    for context in (b"", b"a"):
        dishes = [w for before, w in counts if before == context]
        trails = lambda ws: np.array([got[w].trail[:2] for w in ws], np.float32)
        t = lm.pair_seats(
            np.array([counts[context, w] for w in dishes]), trails(dishes), trails([context] * len(dishes)),
            np.array([keys[context]] * len(dishes)), np.array([keys[w] for w in dishes]), 0.7, 5,
        )
        assert t.sum() == got[context].trail[-1]


def test_texts_are_read_once_and_only_numbers_shuffled(spark):
    texts = ["  One two\tTWO\n", "", None, "\x0b É é\x1f b \x0c", "two One two"] * 4
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = rows.mapInArrow(counting, rows.schema)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    scored = lm.scores(docs)
    against(scored.collect(), list(enumerate(texts)))
    assert read.value == len(texts)
    assert not re.search(r"\btext#", scored._jdf.queryExecution().optimizedPlan().toString())
    assert spark.conf.get(setting) == before


def test_blocks_go_there_and_back():
    wide = np.array([0, 1, -1, 2**40, -(2**62)])
    assert (lm.unpacked(lm.packed_wide(wide)).view(np.int64) == wide).all()
    assert (lm.unpacked_steps(lm.packed_steps(np.array([5, 3, 70_000, 0]))) == [5, 3, 70_000, 0]).all()
    assert len(lm.unpacked(lm.packed([]))) == 0
    words = pa.array([b"", b"ab", b"\xc3\xa9", b""], pa.large_binary())
    for some in (words, words.slice(1, 2), words.slice(0, 0), words.slice(3, 1)):
        assert lm.unpacked_words(lm.packed_words(some)).to_pylist() == some.to_pylist()
    keys = np.sort(np.array([0, 1, 2**24, 2**47, 2**48 - 1], np.uint64))
    assert lm.bucket_of(keys, 7).tolist() == [0, 0, 0, 3, 6]


def test_states_of_pairs_are_averaged(spark, monkeypatch):
    """The default is the mean of two states, each with seats of pairs and levels below of its own."""
    texts = [(i, " ".join(("a b a b c", "a b d", "b a b", "c d a", "d")[(i + j) % 5] for j in range(4))) for i in range(20)]
    docs = spark.createDataFrame([*texts, (100, "a"), (101, "b")], "doc_id long, text string")
    kept, seats, train = [], lm.seats_of, lm.train
    monkeypatch.setattr(lm, "seats_of", lambda *a: kept.append("pairs") or seats(*a))
    monkeypatch.setattr(lm, "train", lambda *a: kept.append(a[4]) or train(*a))
    mean = {r.doc_id: 10**r.score for r in lm.scores(docs).collect()}
    assert kept == [1, "pairs", 3, "pairs", 3]
    one = {r.doc_id: 10**r.score for r in lm.scores(docs, pair_sweeps=1).collect()}
    none = {r.doc_id: 10**r.score for r in lm.scores(docs, pair_sweeps=0).collect()}
    assert all(0 < mean[i] < 1 for i in mean) and mean[0] != one[0] != none[0]
    # The first state is that of a single sweep, and its share is half of each chance: a text of two
    # tokens keeps at least a quarter of its chance there.
    assert all(mean[i] > one[i] / 4 for i in (100, 101))
