import itertools
import random
import re

from pyspark.sql import functions as F

from gazetide.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask int, key string, part string"


def brute(rows, labels):
    """Every order applied to all documents, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}

    def failed(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and any(j is not None and j < i and t == text for j, t, _ in rows),
        }

    rows = [(i, t or "", p or "") for i, t, p in rows]
    judged = [(i, p, failed(i, t)) for i, t, p in rows]
    out = {}
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[letter] for _, f in mine) - len(gone),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step].append(total[letter])
    return out


def audited(spark, path, labels, batches):
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counters = filter_audit.followed(spark, path, labels, batches=batches)
    have = {}
    for r in filter_audit.report(counters.counts()).collect():
        have[r.part, r.filter_order, r.step] = [
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        ]
    return have, counters


def made_rows():
    rng = random.Random(3)
    texts = [
        " ".join(rng.choice(["alpha", "Beta", "G", "de", "x\x0by"]) + (str(k) if rng.random() < mix else "") for k in range(n))
        for n, mix in [(99, 1), (100, 1), (100, 0.6), (120, 0.7), (130, 0.95), (3, 0), (150, 0.85)]
    ]
    texts += [texts[1] + " #", "A" * 11 + "b" * 99, "A" * 10 + "b" * 90, "\x0b\t", None, "", "one 100%", "é" * 9 + "A"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    # One id twice with one text, one id with two texts, no id.
    rows += [(3, "twice", "en"), (3, "twice", "de"), (3, texts[0], "en"), (None, "twice", "en"), (None, texts[1], None), (2000, "twice", "en")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 150, 2)] + [(3, 1, None), (3, 0, 1)]
    return rows, labels


def test_against_brute_force_with_smaller_ids_in_later_files(spark, tmp_path):
    rows, labels = made_rows()
    rng = random.Random(1)
    spread = sorted(rows, key=lambda r: -(r[0] or 0) + rng.randint(0, 40))
    for at in range(0, len(spread), 30):
        spark.createDataFrame([(*r, 7, "x", "y") for r in spread[at : at + 30]], SCHEMA).coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "docs"))
    want = brute(rows, labels)
    have, counters = audited(spark, str(tmp_path / "docs"), labels, batches=4)
    assert have == want
    assert len(counters.epochs) > 2
    later = spark.read.parquet(f"{counters.folder}/counts/epoch={counters.epochs[-1]}")
    assert later.where("n < 0").count() > 0  # something counted before was taken back
    assert audited(spark, str(tmp_path / "docs"), labels, batches=1)[0] == want


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    counters = filter_audit.Counters(
        spark, spark.createDataFrame([], "doc_id long, good int, toxic int"), str(tmp_path / "state")
    )
    for epoch, rows in enumerate([[(5, "a b", "en"), (6, "a b", "en")], [(1, "a b", "de")]]):
        batch = filter_audit.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("lang"))
        counters.add(batch, epoch)
        once = sorted(counters.counts().collect())
        counters.add(batch, epoch)
        assert sorted(counters.counts().collect()) == once
    assert [(r.part, r.mask, r.n) for r in once] == [("de", 1, 1), ("en", 17, 2)]


def test_empty_table_and_long_text(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(str(tmp_path / "none"))
    assert audited(spark, str(tmp_path / "none"), [], batches=4)[0] == {}
    long = [(2, "word " * 400_000, "en"), (1, "word " * 400_000, "en")]
    spark.createDataFrame([(*r, 7, "x", "y") for r in long], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "long"))
    have, _ = audited(spark, str(tmp_path / "long"), [], batches=4)
    assert have["en", "BEACD", 1][:2] == [0, 2] and have["en", "EBACD", 1][:2] == [1, 1]
