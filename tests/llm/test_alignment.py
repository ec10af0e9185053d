import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gazetide.llm import alignment
from gazetide.llm.packing import byte_characters
from gazetide.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, block long, `key` string, chunk string"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def whole():
    """(A's, B's) tokens of a whole text as (id, end), by the tokenizers themselves."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of_char = {c: bytes([x]) for x, c in byte_characters().items()}

    def placed(parts, want):
        out, end = [], 0
        for i, part in parts:
            end += len(part)
            out.append((i, end))
        return out if b"".join(p for _, p in parts) == want else None

    def tokens(text):
        want = (" " + text).encode()
        of_a = [(i, b"".join(of_char[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = [
            (i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
            for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))
        ]
        return placed(of_a, want), placed(of_b, want)

    return tokens


def brute(tokens, rows):
    docs, counts = [], Counter()
    for i, text in rows:
        a, b = tokens(text) if text else (None, None)
        groups = []
        if a and b:
            common, at = sorted({e for _, e in a} & {e for _, e in b}), 0
            for end in common:
                groups.append(tuple([t for t, e in side if at < e <= end] for side in (a, b)))
                at = end
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        docs.append((i, groups, links))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, groups, links in docs:
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in links.items()),
            hashlib.sha256(line.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr), counts, top


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", *COLUMNS).collect()), key=repr)


PARTS = [
    "a", "the", " the", "  ", " ", "\n", "\t", "'s", "don't", " 12", "345", ".", "!!", "é", "ß", "▁", "日本", "語", "　", "\xa0",
    "\x85", "\x00", "🙂", "é", "<|endoftext|>", "</s>", "<0x41>", "<unk>", " token", "izer", "aaaaaaaaaaaaaaa", " =====", "\r\n",
    "﻿", " Ünï", "zwölf ",
]


def odd_texts(n, longest):
    rng = random.Random(9)
    texts = [None, "", " ", "  a", "▁", "x▁y", "one two", "one two", "a" * 300, " " * 50, "日本語" * 40]
    plain = [p for p in PARTS if p != "▁"]
    return texts + ["".join(rng.choices(plain, k=rng.randint(0, longest))) for _ in range(n)]


def test_units_are_encoded_as_in_their_text(whole):
    tokenizers = alignment.Tokenizers(A, B)
    for text in odd_texts(1500, 12)[2:]:
        units = alignment.CUT.split((" " + text).encode())
        want, at = whole(text), 0
        have, spelled = ([], []), True
        for unit in units:
            good, bad, t = tokenizers.tokens([unit])
            spelled &= not bad
            for side, (ids, ends) in enumerate(((t.a, t.a_ends), (t.b, t.b_ends))):
                have[side].extend((i, at + e) for i, e in zip(ids.tolist(), ends.tolist()))
            at += len(unit)
        assert spelled == (None not in want)
        if spelled:
            assert have == want


def test_units_are_encoded_together_as_alone(whole):
    tokenizers = alignment.Tokenizers(A, B)
    units = list(dict.fromkeys(u for t in odd_texts(400, 30)[2:] for u in alignment.CUT.split((" " + t).encode())))
    good, bad, t = tokenizers.tokens(units)
    alone = [tokenizers.tokens([u])[2] for u in good]
    assert set(good) | set(bad) == set(units) and bad
    for name in ("a", "b"):
        assert getattr(t, name).tolist() == [i for x in alone for i in getattr(x, name).tolist()]


def test_links_of_a_huge_group(monkeypatch, whole):
    tokenizers = alignment.Tokenizers(A, B)
    units = list(dict.fromkeys(u for t in odd_texts(200, 30)[2:] for u in alignment.CUT.split((" " + t).encode())))

    def all_links():
        block = alignment.Block(tokenizers, 0)
        block.learn(units)
        numbers = sorted(set(range(len(block.texts))) - block.bad)
        return [block.record([n], block.arrays())[0] for n in numbers], block

    def decoded(records, block):
        codes, out = list(block.pair_of), []
        for r in records:
            places = np.cumsum(np.frombuffer(r["bag"], "<u4").astype(int)).tolist()
            out.append((r["n_links"], {codes[p]: n for p, n in zip(places, np.frombuffer(r["times"], "<u8").tolist())}))
        return out

    plain = decoded(*all_links())
    monkeypatch.setattr(alignment, "HUGE", 1)
    assert decoded(*all_links()) == plain
    assert all(n == sum(links.values()) for n, links in plain)


def test_query_against_brute_force(spark, whole):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op11_alignment"](spark, SF)) == brute(whole, rows)[0]


def test_byte_ranges_against_brute_force(spark, whole):
    rows = list(enumerate(odd_texts(150, 60)))
    rows += [(None, "no id"), (7, "other text of 7"), (500, "word " * 400), (501, "x▁ " + "word " * 100)]
    docs = spark.createDataFrame([(*r, 1, "k", "c") for r in rows], SCHEMA).repartition(3)
    want, counts, top = brute(whole, rows)
    for chunk in (7, 64, 1 << 16):
        found = alignment.aligned(docs, A, B, chunk_bytes=chunk, block_bytes=2000)
        assert rows_of(found.documents) == want
    pairs = {(r.a_id, r.b_id): (r.documents, r.best) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == top[p[0]]) for p, n in counts.items()}


def test_fragments_compose_in_any_grouping(whole):
    """Composition is associative, and edges may lie anywhere, inside a token too."""
    rng = random.Random(2)
    for text in [t for t in odd_texts(60, 40) if t]:
        a, b = whole(text)
        if b is None:
            continue
        size = len((" " + text).encode())
        edges = [0, *sorted(rng.sample(range(1, size), min(size - 1, rng.randint(0, 9)))), size]
        parts = []
        for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
            groups, rest = alignment.cut_groups(*([(t, e) for t, e in side if lo < e <= hi] for side in (a, b)))
            closed = groups[1:]
            parts.append(alignment.Fragment(
                True, sum(len(x) for x, _ in closed), sum(len(y) for _, y in closed), len(closed),
                sum(len(x) * len(y) for x, y in closed), bool(groups), n,
                groups[0] if groups else rest, rest if groups else ([], []), (),
            ))
        left = parts[0]
        for p in parts[1:]:
            left = alignment.composed(left, p)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [alignment.composed(parts[i], parts[i + 1])]
        assert parts[0] == left and left.bounded and left.suffix == ([], [])
        groups = alignment.cut_groups(a, b)[0]
        assert left.n_groups + 1 == len(groups)
        assert left.n_a + len(left.prefix[0]) == len(a) and left.n_b + len(left.prefix[1]) == len(b)


def test_a_unit_longer_than_a_range_moves_the_edge(spark, whole):
    rows = [(1, "b" * 500 + " then words " + "c" * 90 + " end"), (2, "日" * 200)]
    docs = spark.createDataFrame([(*r, 1, "k", "c") for r in rows], SCHEMA)
    assert rows_of(alignment.aligned(docs, A, B, chunk_bytes=50).documents) == brute(whole, rows)[0]


def test_empty_table_and_invalid_text(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.aligned(docs, A, B).documents.collect() == []
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert rows_of(alignment.aligned(broken, A, B).documents) == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert rows_of(alignment.aligned(broken, A, B, chunk_bytes=2).documents) == [(1, 0, 0, 0, 0, 0, 0, "")]
