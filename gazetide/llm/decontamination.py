"""Benchmark decontamination with suffix arrays over the training text.

Each task lays the words of its documents end to end, shard by shard, sorts the suffixes and
looks every test suffix up by binary search; equal ranges give the places of verbatim matches,
and neighbouring matches of one passage give the longest. Words are numbered by the test texts'
vocabulary. A word the test texts lack matches nothing, so suffixes are left out that meet one
before the shortest window ends. Depth is the window: more words are reached by consecutive
windows. Training text is never shuffled.

Test texts are taken in blocks of at most ``block_words`` words; a block goes to every task, its
size is that bound, and there are as many passes as blocks.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is
one window. Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond
ASCII.

Defined results: null and empty texts have no words and no hits. Items without an id or words
match nothing; items that repeat an id count once. Rows that repeat a document are judged each.
An empty benchmark leaves every document clean. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetide.llm.common import unused
from gazetide.session import cut_lineage

# Bytes that are no part of a word become spaces; A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

HITS = (
    "doc_id long, n_words long, "
    "spans array<struct<start:long,length:long,item_id:string,item_start:long>>, items array<string>, n_hit long"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Passages:
    """The windows of a block of test items, as numbers."""

    PACK, BITS = 3, 21  # words in one uint64

    def __init__(self, items: list[tuple[str, str]], window: int):
        import numpy as np

        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        rows, self.of_item, self.at, sizes = [], [], [], []
        self.items = [item for item, _ in items]
        for i, (_, text) in enumerate(items):
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                rows.append(ids[at : at + size] + [0] * (window - size))
                sizes.append(size)
                self.of_item.append(i)
                self.at.append(at)
        self.sizes = np.array(sizes, np.int64)
        self.suffixes = np.array(rows, np.int64).reshape(len(rows), window)
        self.shortest = int(self.sizes.min()) if rows else 0

    def columns(self, words):
        """Groups of ``PACK`` word numbers as one number each: (n, groups)."""
        import numpy as np

        pad = -words.shape[1] % self.PACK
        words = np.pad(words, ((0, 0), (0, pad))).astype(np.uint64)
        out = words[:, 0 :: self.PACK]
        for j in range(1, self.PACK):
            out = (out << np.uint64(self.BITS)) | words[:, j :: self.PACK]
        return out

    def matches(self, ids):
        """(place in ``ids``, number of the window) of every match. ``ids``: word numbers of a
        shard, 0 between documents and for words that are not in the vocabulary."""
        import numpy as np

        none = np.zeros(0, np.int64)
        if not len(self.sizes) or len(ids) < self.shortest:
            return none, none
        # Known words from each place on, as far as the shortest window.
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        starts = np.flatnonzero(unknown[self.shortest :] == unknown[: len(unknown) - self.shortest])
        if not len(starts):
            return none, none
        padded = np.concatenate((ids, np.zeros(self.window, np.int64)))
        # The suffix array: by the first words, then by the further ones where those are equal.
        first = self.columns(padded[starts[:, None] + np.arange(self.PACK)])[:, 0]
        order = np.argsort(first, kind="stable")
        starts, first = starts[order], first[order]
        equal = np.zeros(len(first), bool)
        equal[1:] |= first[1:] == first[:-1]
        equal[:-1] |= first[1:] == first[:-1]
        tied = np.flatnonzero(equal)
        if len(tied):
            further = self.columns(padded[starts[tied][:, None] + np.arange(self.window)])
            starts[tied] = starts[tied][np.lexsort(further.T[::-1])]
        found_at, found = [], []
        for size in np.unique(self.sizes):
            which = np.flatnonzero(self.sizes == size)
            wanted = self.columns(self.suffixes[which][:, :size])
            low, high = (self._bound(padded, starts, wanted, int(size), right) for right in (False, True))
            n = high - low
            hit = np.repeat(np.arange(len(which)), n)
            found_at.append(starts[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
            found.append(which[hit])
        return np.concatenate(found_at), np.concatenate(found)

    def _bound(self, padded, starts, wanted, size: int, right: bool):
        """Binary search of all wanted windows at once: the first suffix that is not smaller, or
        that is greater."""
        import numpy as np

        low = np.zeros(len(wanted), np.int64)
        high = np.full(len(wanted), len(starts), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            there = self.columns(padded[starts[middle][:, None] + np.arange(size)])
            differs = there != wanted[open_]
            column = np.argmax(differs, axis=1)
            row = np.arange(len(open_))
            smaller = there[row, column] < wanted[open_][row, column]
            go_on = np.where(differs.any(axis=1), smaller, right)
            low[open_[go_on]] = middle[go_on] + 1
            high[open_[~go_on]] = middle[~go_on]
        return low


SHARD_WORDS = 500_000


def _search(docs: DataFrame, passages: Passages) -> DataFrame:
    def shard(doc_ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        import numpy as np

        number = passages.vocabulary.get
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        ids = np.fromiter((number(w, 0) for t in texts for w in (*t, b"")), np.int64, int(sizes.sum()) + len(texts))
        at, found = passages.matches(ids)
        owner = np.searchsorted(begins, at, side="right") - 1
        rows: dict[int, list] = {}
        for d, place, w in zip(owner.tolist(), (at - begins[owner]).tolist(), found.tolist()):
            rows.setdefault(d, []).append((passages.of_item[w], place - passages.at[w], place, int(passages.sizes[w]), passages.at[w]))
        spans, items, n_hit = [], [], []
        for d in range(len(texts)):
            own: list[dict] = []
            for item, diagonal, place, size, item_at in sorted(rows.get(d, ())):
                last = own[-1] if own else None
                # The next window of the same passage makes the match longer by a word.
                if last and last["item"] == (item, diagonal) and place == last["start"] + last["length"] - size + 1:
                    last["length"] += 1
                else:
                    own.append({"item": (item, diagonal), "start": place, "length": size, "item_id": passages.items[item], "item_start": item_at})
            covered, end = 0, 0
            for span in sorted(own, key=lambda s: s["start"]):
                stop = span["start"] + span["length"]
                covered += max(0, stop - max(end, span["start"]))
                end = max(end, stop)
            spans.append([{k: s[k] for k in ("start", "length", "item_id", "item_start")} for s in own])
            items.append(sorted({s["item_id"] for s in own}))
            n_hit.append(covered)
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids, pa.int64()),
                pa.array(sizes),
                pa.array(spans, pa.list_(kind)),
                pa.array(items, pa.list_(pa.string())),
                pa.array(n_hit, pa.int64()),
            ],
            names=["doc_id", "n_words", "spans", "items", "n_hit"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(words_of(text.as_py()))
                held += len(texts[-1])
                if held >= SHARD_WORDS:
                    yield shard(doc_ids, texts)
                    doc_ids, texts, held = [], [], 0
        if doc_ids:
            yield shard(doc_ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HITS)


def test_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in blocks of at most ``block_words`` words (one item at least)."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where(
        "item_id is not null and text is not null"
    )
    # A word has a byte and a byte that ends it.
    words = F.floor((F.octet_length("text") + 1) / 2) + 1
    total = items.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-2 * total // block_words)) if total > block_words else 1
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """For every document: ``n_words``; ``spans``, its longest verbatim matches with the item and
    the place in it; ``items``, the ids of the items that occur; ``n_hit``, the words inside."""
    blocks = test_blocks(benchmark, block_words)
    if len(blocks) > 1:
        docs = cut_lineage(docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id()))
    parts = []
    for block in blocks:
        found = _search(docs if len(blocks) == 1 else docs.select(F.col("__row").alias("doc_id"), "text"), Passages([tuple(r) for r in block.collect()], window))
        if len(blocks) == 1:
            return found
        parts.append(cut_lineage(found))
    together = parts[0]
    for part in parts[1:]:
        together = together.union(part)
    merged = together.groupBy(F.col("doc_id").alias("__row")).agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    ends = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda have, s: F.struct(
            (have["n"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["length"] - F.greatest(have["end"], s["start"]))).alias("n"),
            F.greatest(have["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda have: have["n"],
    )
    return docs.select("__row", F.col("doc_id").cast("long")).join(merged, "__row").select(
        "doc_id", "n_words", "spans", "items", ends.alias("n_hit")
    )


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without the contaminated rows. Every row goes or stays by its own text, whatever
    its id is and whether others have it."""
    key = unused(docs, "__key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = matches(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, window).where(CONTAMINATED)
    bad = cut_lineage(found.select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(bad, key, "left_anti").select(docs.columns)
