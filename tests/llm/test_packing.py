import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from gazetide.llm import packing
from gazetide.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", " ", "\n", "\t", "'s", "'", "1", "22", ".", "!!", "é", "ß", "the", " the", "  ", "\r\n", "don't", "abcdefghijklmnopqrstuvw", "\x7f", "　", "<|endoftext|>", "\xa0", "\x85", "日本"]


def test_encoder_agrees_with_the_tokenizer():
    whole, encoder, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(1)
    for n in (len(PARTS) - 7, len(PARTS)):
        texts = [None, ""] + ["".join(rng.choices(PARTS[:n], k=rng.randint(0, 14))) for _ in range(1500)]
        ids, sizes = encoder.encode(pa.array(texts, pa.string()), 0)
        for text, end, size in zip(texts, np.cumsum(sizes), sizes):
            assert ids[end - size : end].tolist() == whole.encode(text or "", add_special_tokens=False).ids + [0]
    assert encoder.encode(pa.array([], pa.string()), 0)[1].tolist() == []


def test_units_that_share_a_hash_are_told_apart():
    data = np.frombuffer(b"abcabdabc" + b"x" * 40, np.uint8)
    first, inverse = packing.distinct(data, np.array([0, 3, 6]), np.array([3, 3, 3]), 16)
    assert inverse[0] == inverse[2] != inverse[1] and len(first) == 2


def check(rows, texts, capacity):
    whole = Tokenizer.from_file(PATH)
    want = {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    have = {i: [] for i in texts}
    line = {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.length == len(ids) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        have[r.doc_id].append((r.start, r.length))
        line.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in have.items():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) == len(want[i])
    assert sorted(line) == list(range(len(line)))
    for s, pieces in line.items():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) == capacity or s == len(line) - 1


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(QUERIES["op1_packing"](spark, SF).collect(), texts, 1024)


def test_odd_rows_and_sequences(spark):
    texts = {0: None, 1: "", 2: "one two three", 3: "long " * 300, 4: "one two three", 5: "é" * 7}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, part int, ids string").repartition(3)
    pieces = packing.pack(df, PATH, capacity=16).cache()
    check(packing.digest(pieces).collect(), texts, 16)
    whole = b"".join(bytes(r.ids) for r in pieces.orderBy("sequence_id", "offset").collect())
    rows = packing.sequences(pieces, capacity=16, pad=5).orderBy("sequence_id").collect()
    assert b"".join(bytes(r.ids)[: 4 * r.n_tokens] for r in rows) == whole
    assert all(len(r.ids) == 64 for r in rows)
    assert packing.pack(df.where("false"), PATH).collect() == []
