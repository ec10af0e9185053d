"""Language-model scoring with a hierarchical Pitman-Yor model.

Words are customers of the restaurant of the word before them (the end before the first). The
parent of these is one restaurant of words, whose dishes are all byte strings; its base spells a
word letter by letter in restaurants of letter contexts: the last two bytes, whose parent is the last
byte, whose parent has no context, whose base is uniform. Each table of a restaurant is one
customer of its parent, so contexts share what their parents learn. A text is its words and one
end, the empty word. As in the base score, words outside the training text are one dish: its
probability is what the spelling leaves to all strings that were never seen.

Seating is sampled at every level by blocked Gibbs sweeps. In the contexts of words they begin with
one table for each known pair (what interpolated Kneser-Ney smoothing assumes); pairs that occur once
keep it, the others are drawn anew against the word restaurant and the tables of their context. The
tables drawn are the customers of the word restaurant until the next sweep over the pairs, and the levels
below are sampled again. Each sweep over the pairs leaves a state of all levels; predictive
probabilities are averaged over these. Draws are hashes, the same on every attempt. At all levels, given all other seats, the customers of a dish leave and come back one
after another as the Chinese restaurant process has it (in growing blocks once many sit), in two
drafts of which one is chosen by its weight. Below the pairs, predictive probabilities are averaged
over the sweeps after the first.

What is counted grows with the corpus and stays distributed: the word table has one row per
distinct word. Letter contexts are bounded whatever the corpus: at most 257 * 257 contexts of
257 dishes; those counts go to the driver and back to the tasks. Documents are read once, in
shards, one per scan partition: what is kept of them are the numbers of their tokens, so texts are
not shuffled. All else travels as compressed blocks of columns between shards and buckets, which
hold the words of a range of keys (hashes) and the pairs that these begin. A shard sends its
distinct words and pairs to buckets. Buckets ask each other for chances of words, draw the seats of
pairs, and send counts, seats and chances back in the order in which shards sent words and pairs.
A shard's tokens and a bucket's pairs are in the memory of one task.

Defined results: a null or empty text is its end alone. Rows with a null id are in training. With
no training text every probability comes from the base. Repeated rows are counted and scored each.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetide.llm.common import fold_of, shuffles_dropped, written

END, START, SYMBOLS = 256, 257, 258


#: So many texts are tokenised at once.
PORTION = 1_000
BLOCKS = (
    "shard int, doc_ids array<bigint>, held array<boolean>, lengths binary, ids binary, words binary, times binary, n binary"
)


def shard_blocks(docs: DataFrame) -> DataFrame:
    """One row for each shard: its documents, their lengths in tokens and the numbers of these
    tokens, its words in the order of their keys, how often each occurs and how often in training.
    Numbers go to words by how often they occur, ties in the order of keys."""

    def tokens(texts: pa.Array):
        """Lengths and numbered tokens of some texts, as an array with a dictionary."""
        import numpy as np
        import pyarrow.compute as pc

        found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        values, offsets = found.flatten(), np.append(0, np.cumsum(found.value_lengths().to_numpy()))
        # The end comes first. White space at the ends of a text leaves empty values.
        coded = pa.concat_arrays([pa.array([""], values.type), values]).dictionary_encode()
        del found, values
        of = coded.indices.to_numpy()[1:]
        size = np.diff(np.append(0, np.cumsum(of != 0, dtype=np.int32))[offsets])
        line = np.zeros(int(size.sum()) + len(size), np.int32)
        inside = np.ones(len(line), bool)
        inside[np.cumsum(size + 1) - 1] = False
        line[inside] = of[of != 0]
        return size + 1, pa.DictionaryArray.from_arrays(pa.array(line), coded.dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        doc_ids, held, lengths, codes, shard = [], [], [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                shard = part.column(0)[0].as_py()
                doc_ids.extend(part.column(1).to_pylist())
                held.extend(part.column(2).to_pylist())
                size, coded = tokens(part.column(3))
                lengths.append(size)
                codes.append(coded)
        if shard is None:
            return
        coded = pa.chunked_array(codes).unify_dictionaries()
        codes.clear()
        line = np.concatenate([x.indices.to_numpy() for x in coded.chunks])
        dictionary = coded.chunk(0).dictionary.cast(pa.large_binary())
        del coded
        pa.default_memory_pool().release_unused()
        order = np.argsort(word_keys(dictionary), kind="stable")
        size = np.concatenate(lengths)
        training = np.repeat(~np.array(held, bool), size)
        times = np.bincount(line, minlength=len(order))[order]
        n = np.bincount(line[training], minlength=len(order))[order]
        number = np.empty(len(order), np.int32)
        number[order[by_times(times)]] = np.arange(len(order))
        row = [shard], [doc_ids], [held], [packed(size)], [packed(number[line])], [packed_words(dictionary.take(pa.array(order)))], [packed(times)], [packed(n)]
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5)
        names = [field.split()[0] for field in BLOCKS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=names)

    return docs.mapInArrow(run, BLOCKS)


def released(found: pa.Table) -> pa.Table:
    """``found``, after Arrow's allocator gave back what it holds unused: workers are used again."""
    pa.default_memory_pool().release_unused()
    return found


def by_times(times):
    """The order that numbers the words of a shard."""
    import numpy as np

    return np.argsort(-times, kind="stable")


def symbols_of(words: pa.Array):
    """(codes of (byte before last, last byte, next symbol), where each word's codes begin)."""
    import numpy as np

    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    begins = np.cumsum(sizes + 1) - sizes - 1
    line = np.full(int(sizes.sum()) + len(sizes), END, np.int64)
    inside = np.ones(len(line), bool)
    inside[begins + sizes] = False
    line[inside] = raw
    one, two = np.roll(line, 1), np.roll(line, 2)
    one[begins], two[begins] = START, START
    second = begins[sizes > 0] + 1
    two[second] = START
    return (two * SYMBOLS + one) * SYMBOLS + line, begins


def uniforms(seed, rows, step: int):
    """Numbers in (0, 1) by hashes of (seed, row's number, step): the same on every attempt."""
    import numpy as np

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    start = (seed * 1_000_003 + step) * 0x9E3779B97F4A7C15 % 2**64
    mixed = mix(rows + np.uint64(start))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def normal_of(u):
    """Standard normal numbers from uniform ones (logistic approximation of the quantile)."""
    import numpy as np

    return np.log(u / (1 - u)) / 1.702


def seated(counts, base, discount: float, strength: float, tables: float, seed: int, keys, own: bool = False):
    """Tables of each dish, sampled: ``counts`` customers with base probability ``base`` in a
    restaurant with ``tables`` tables of other dishes. With ``own``, tables that the dish has taken
    so far count beside them. Two drafts, one chosen by weight."""
    import numpy as np

    tables = np.broadcast_to(np.asarray(tables, np.float64), counts.shape)

    def draft(number: int):
        t = np.minimum(counts, 1).astype(np.float64)
        seats = t.copy()
        weight = np.zeros(len(counts))
        step = 0
        alive = np.flatnonzero(counts > seats)
        while len(alive):
            # One customer at a time at first, then an eighth of those seated.
            block = np.minimum(np.maximum(1, seats[alive] // 8), counts[alive] - seats[alive])
            new = (strength + discount * (tables[alive] + t[alive] if own else tables[alive])) * base[alive]
            old = np.maximum(seats[alive] - discount * t[alive], 1e-12)
            p = new / (new + old)
            u = uniforms(seed * 2 + number, keys[alive], step)
            mean = block * p
            many = np.rint(mean + np.sqrt(mean * (1 - p)) * normal_of(u))
            few = np.where(u < mean, 1.0, 0.0)
            t[alive] += np.where(block == 1, u < p, np.where(mean > 4, np.clip(many, 0, block), few))
            weight[alive] += block * np.log(new + old)
            seats[alive] += block
            step += 1
            alive = alive[counts[alive] > seats[alive]]
        return t, weight

    (t, w), (t2, w2) = draft(0), draft(1)
    pick = uniforms(seed * 2 + 1, keys, 9_999) < 1 / (1 + np.exp(np.clip(w - w2, -60, 60)))
    return np.where(pick, t2, t)


def discount_of(counts) -> float:
    """From the counts of counts."""
    import numpy as np

    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


class Spelling:
    """The letter restaurants after a sweep: what spells a word."""

    def __init__(self, codes, customers, seed: int, before: "Spelling | None" = None):
        """``codes``, ``customers``: letters in contexts of two bytes, sent by the word tables."""
        import numpy as np

        order = np.argsort(codes)
        self.codes, c2 = codes[order], customers[order].astype(np.float64)
        context, self.strength = self.codes // SYMBOLS, 1.0
        letter, last = self.codes % SYMBOLS, (self.codes // SYMBOLS) % SYMBOLS
        self.d2 = discount_of(c2)
        p1 = before.p1 if before else np.full((SYMBOLS, SYMBOLS), 1 / 257)
        t_context = before.t_context if before else np.zeros(SYMBOLS * SYMBOLS)
        t2 = seated(c2, p1[last, letter], self.d2, self.strength, t_context[context], seed, self.codes.astype(np.uint64))
        # Tables are the customers of the parent.
        cells, at = np.unique(self.codes % SYMBOLS**2, return_inverse=True)
        c1 = np.bincount(at, t2, len(cells)) if len(cells) else np.zeros(0)
        d1 = discount_of(c1)
        l1, s1 = cells // SYMBOLS, cells % SYMBOLS
        p0 = before.p0 if before else np.full(SYMBOLS, 1 / 257)
        t_last = before.t_last if before else np.zeros(SYMBOLS)
        t1 = seated(c1, p0[s1], d1, self.strength, t_last[l1], seed + 1, cells.astype(np.uint64))
        c0 = np.bincount(s1, t1, SYMBOLS)
        d0 = discount_of(c0[c0 > 0])
        t0 = seated(c0, np.full(SYMBOLS, 1 / 257), d0, self.strength, 0.0, seed + 2, np.arange(SYMBOLS, dtype=np.uint64))
        self.p0 = (np.maximum(c0 - d0 * t0, 0) + (self.strength + d0 * t0.sum()) / 257) / (self.strength + c0.sum())
        self.p0[START] = 0.0
        total1, self.t_last = np.bincount(l1, c1, SYMBOLS), np.bincount(l1, t1, SYMBOLS)
        back1 = (self.strength + d1 * self.t_last) / (self.strength + total1)
        self.p1 = back1[:, None] * self.p0[None, :]
        self.p1[l1, s1] += (c1 - d1 * t1) / (self.strength + total1[l1])
        total2, self.t_context = (np.bincount(context, x, SYMBOLS * SYMBOLS) for x in (c2, t2))
        self.back2 = (self.strength + self.d2 * self.t_context) / (self.strength + total2)
        self.own = (c2 - self.d2 * t2) / (self.strength + total2[context])

    def log_spelled(self, words: pa.Array):
        """Natural log of the probability that the letters spell each word."""
        return self.log_of(*symbols_of(words))

    def log_of(self, codes, begins):
        """The same for words whose symbols are known."""
        import numpy as np

        if not len(begins):
            return np.zeros(0)
        p = self.back2[codes // SYMBOLS] * self.p1[(codes // SYMBOLS) % SYMBOLS, codes % SYMBOLS]
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            p += np.where(self.codes[at] == codes, self.own[at], 0.0)
        return np.add.reduceat(np.log(p), begins)


def word_keys(words: pa.Array):
    import numpy as np
    import xxhash

    parts = (words.slice(at, 20_000).to_pylist() for at in range(0, len(words), 20_000))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for part in parts for w in part), np.uint64, len(words))


def bucket_of(keys, buckets: int):
    """The bucket of 48-bit keys, in numpy or as a column."""
    if isinstance(keys, Column):
        return F.shiftright(F.shiftright(keys, 24) * buckets, 24).cast("int")
    import numpy as np

    return (((keys >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def packed(numbers) -> bytes:
    """32-bit numbers, byte by byte: the first of all, then the second."""
    import numpy as np

    planes = np.ascontiguousarray(np.asarray(numbers).astype(np.int32, copy=False)).view(np.uint8).reshape(-1, 4).T
    return np.int32(len(numbers)).tobytes() + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes):
    import numpy as np

    size = int(np.frombuffer(data[:4], np.int32)[0])
    if not size:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data[4:], 4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


def packed_wide(numbers) -> bytes:
    """64-bit numbers of either kind."""
    import numpy as np

    return packed(np.ascontiguousarray(numbers).view(np.int32))


def packed_steps(numbers) -> bytes:
    import numpy as np

    return packed(np.diff(numbers, prepend=0))


def unpacked_steps(data: bytes):
    import numpy as np

    return np.cumsum(unpacked(data), dtype=np.int64)


def packed_words(words: pa.Array) -> bytes:
    import numpy as np

    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if data is not None and len(offsets) else b""
    sizes = packed(np.diff(offsets))
    return np.int64(len(sizes)).tobytes() + sizes + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_words(data: bytes) -> pa.Array:
    import numpy as np

    end = 8 + int(np.frombuffer(data[:8], np.int64)[0])
    offsets = np.append(0, np.cumsum(unpacked(data[8:end]), dtype=np.int64))
    raw = pa.decompress(data[end:], int(offsets[-1]), codec="zstd") if offsets[-1] else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), raw])


def six(keys) -> bytes:
    import numpy as np

    return np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def of_six(data: bytes):
    import numpy as np

    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pair_codes(line, lengths, size: int):
    """Previous word times ``size`` plus word for each token of texts that end with the end."""
    import numpy as np

    out = np.empty(len(line), np.int64)
    out[1:] = line[:-1]
    if len(line):
        out[np.append(0, np.cumsum(lengths)[:-1])] = line[-1]
    out *= size
    out += line
    return out


PAIR_BLOCKS = (
    "bucket int, shard int, buckets int, vocabulary binary, c binary, runs binary, words binary, word_at binary, n binary"
)


def pair_blocks(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each shard's words and distinct pairs by bucket of the (previous) word: training counts of
    the words, how many pairs each begins, the keys of the second words, which of these each
    pair has, and training counts of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for shard, held, lengths, ids, words, times, n in zip(*(x.to_pylist() for x in batch.columns)):
                lengths, vocabulary, c = unpacked(lengths), unpacked_words(words), unpacked(n)
                keys, size = word_keys(vocabulary) >> np.uint64(16), len(vocabulary)
                line = by_times(unpacked(times))[unpacked(ids)]
                codes = pair_codes(line, lengths, size)
                codes *= 2
                codes += np.repeat(np.array(held, bool), lengths)
                del line
                codes.sort()
                training = np.append(0, np.cumsum(codes & 1 == 0, dtype=np.int32))
                codes >>= 1
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                training = np.diff(training[np.append(first, len(codes))])
                codes = codes[first]
                word = (codes % size).astype(np.int32)
                codes //= size
                runs = np.bincount(codes, minlength=size)
                del codes, first
                pair_ends = np.cumsum(runs)
                names, begins = np.unique(bucket_of(keys, buckets), return_index=True)
                for bucket, at, to in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), size]):
                    p = slice(int(pair_ends[at - 1]) if at else 0, int(pair_ends[to - 1]))
                    own, word_at = np.unique(word[p], return_inverse=True)
                    row = (
                        [bucket], [shard], [buckets], [packed_words(vocabulary.slice(at, to - at))], [packed(c[at:to])],
                        [packed(runs[at:to])], [six(keys[own])], [packed_steps(word_at)], [packed(training[p])],
                    )
                    kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6)
                    fields = [field.split()[0] for field in PAIR_BLOCKS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=fields)
            pa.default_memory_pool().release_unused()

    return blocks.select("shard", "held", "lengths", "ids", "words", "times", "n").mapInArrow(run, PAIR_BLOCKS)


def shard_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    return pair_blocks(shard_blocks(docs), buckets)


PAIR_ANSWERS = (
    "bucket int, shard int, buckets int, counts binary, places binary, again binary, words binary, followers binary, "
    "contexts binary, again_n binary, again_word binary, again_context binary, vocabulary binary, c binary, once long, twice long"
)


def in_order(words, keys) -> pa.Array:
    """Where the words of a bucket lie when sorted: by key, equal keys by word."""
    import pyarrow.compute as pc

    return pc.sort_indices(pa.table({"key": keys, "word": words}), [("key", "ascending"), ("word", "ascending")])


def merged_pairs(sent: DataFrame) -> DataFrame:
    """For each shard of a bucket, in the order in which it sent them: the training count of each
    pair in all shards, the places of its words among the bucket's, and which of the pairs that
    occur again it has. A row without a shard has the bucket's words (``vocabulary``) and their
    counts (``c``), the keys of the second words with the numbers of their distinct contexts in it
    (``counts``), its contexts with the numbers of their distinct words (``followers``), and the
    pairs that occur again, by their places among these."""

    def merge(rows: pa.Table) -> pa.Table:
        import numpy as np

        bucket, buckets = rows.column("bucket")[0].as_py(), rows.column("buckets")[0].as_py()
        shards = rows.column("shard").to_pylist()
        listed = [unpacked_words(x) for x in rows.column("vocabulary").to_pylist()]
        c_word, runs, n = (np.concatenate([unpacked(x) for x in rows.column(f).to_pylist()]) for f in ("c", "runs", "n"))
        coded = pa.concat_arrays(listed).dictionary_encode()
        keys = word_keys(coded.dictionary) >> np.uint64(16)
        order = in_order(coded.dictionary, keys).to_numpy()
        vocabulary, keys = coded.dictionary.take(pa.array(order)), keys[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = place[coded.indices.to_numpy()]
        sent_words = [of_six(x) for x in rows.column("words").to_pylist()]
        words, word = np.unique(np.concatenate(sent_words), return_inverse=True)
        word_from = np.cumsum([0, *map(len, sent_words)])
        word_at = [unpacked_steps(x) for x in rows.column("word_at").to_pylist()]
        pair_at = np.cumsum([0, *map(len, word_at)])
        word = word[np.concatenate([x + word_from[i] for i, x in enumerate(word_at)])]
        pairs, pair = np.unique(np.repeat(place, runs) * max(1, len(words)) + word, return_inverse=True)
        c = np.bincount(pair, n, len(pairs)).astype(np.int64)
        known = pairs[c > 0]
        followers = np.bincount(known // max(1, len(words)), minlength=len(vocabulary))
        before = np.bincount(known % max(1, len(words)), minlength=len(words))
        n_of = np.minimum(c, 2**31 - 1)
        again = c > 1
        again_at = np.cumsum(again) - 1
        counts, places, repeated, word_ends = [], [], [], np.cumsum([0, *map(len, listed)])
        for i in range(len(shards)):
            own = pair[pair_at[i] : pair_at[i + 1]]
            counts.append(packed(n_of[own]))
            places.append(packed_steps(place[word_ends[i] : word_ends[i + 1]]))
            repeated.append(packed_steps(again_at[own[again[own]]]))
        k, at, context_at = len(shards) + 1, np.flatnonzero(before), np.flatnonzero(followers)
        of_bucket = {
            "words": six(words[at]), "followers": packed(followers[context_at]), "contexts": six(keys[context_at]),
            "again_n": packed(n_of[again]), "again_word": packed(np.searchsorted(at, pairs[again] % max(1, len(words)))),
            "again_context": packed_steps(np.searchsorted(context_at, pairs[again] // max(1, len(words)))),
            "vocabulary": packed_words(vocabulary), "c": packed_wide(np.bincount(place, c_word, len(vocabulary)).astype(np.int64)),
        }
        none = [None] * (k - 1)
        return released(pa.table(
            {
                "bucket": pa.array([bucket] * k, pa.int32()),
                "shard": pa.array([*shards, None], pa.int32()),
                "buckets": pa.array([buckets] * k, pa.int32()),
                "counts": pa.array([*counts, packed(before[at])], pa.binary()),
                "places": pa.array([*places, None], pa.binary()),
                "again": pa.array([*repeated, None], pa.binary()),
                **{f: pa.array([*none, x], pa.binary()) for f, x in of_bucket.items()},
                "once": pa.array([*none, int((c == 1).sum())], pa.int64()),
                "twice": pa.array([*none, int((c == 2).sum())], pa.int64()),
            }
        ))

    return sent.groupBy("bucket").applyInArrow(merge, PAIR_ANSWERS)


def counted(answers: DataFrame) -> DataFrame:
    """word, c: the words of all buckets with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for vocabulary, c in zip(*(x.to_pylist() for x in batch.columns)):
                words, c = unpacked_words(vocabulary).cast(pa.binary()), unpacked(c).view(np.int64)
                for at in range(0, len(words), 20_000):
                    part = slice(at, at + 20_000)
                    yield pa.RecordBatch.from_arrays([words[part], pa.array(c[part])], names=["word", "c"])

    return answers.where("shard is null").select("vocabulary", "c").mapInArrow(run, "word binary, c long")


def buckets_of(answers: DataFrame) -> int:
    return answers.agg(F.coalesce(F.max("buckets"), F.lit(1)).alias("n")).first().n


def summed(rows: DataFrame, columns: list[str], read) -> DataFrame:
    """key long and the sums of ``columns`` by it: ``read`` makes keys and numbers of each of ``rows``,
    which begin with how many buckets there are. They travel as blocks by bucket of the key."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for buckets, *row in zip(*(x.to_pylist() for x in batch.columns)):
                keys, *numbers = read(*row)
                homes = bucket_of(keys, buckets)
                order = np.argsort(homes, kind="stable")
                names, begins = np.unique(homes[order], return_index=True)
                out: list[list] = [[], [], *([] for _ in columns)]
                for home, at in zip(names.tolist(), np.split(order, begins[1:])):
                    for x, value in zip(out, (home, six(keys[at]), *(packed(x[at]) for x in numbers))):
                        x.append(value)
                kinds = (pa.int32(), *[pa.binary()] * (1 + len(columns)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["home", "keys", *columns])

    def add(rows: pa.Table) -> pa.Table:
        import numpy as np

        keys, at = np.unique(np.concatenate([of_six(x) for x in rows.column("keys").to_pylist()]), return_inverse=True)
        sums = {f: np.bincount(at, np.concatenate([unpacked(x) for x in rows.column(f).to_pylist()]), len(keys)).astype(np.int64) for f in columns}
        return pa.table({"key": pa.array(keys.astype(np.int64)), **{f: pa.array(x) for f, x in sums.items()}})

    dealt = rows.mapInArrow(deal, "home int, keys binary, " + ", ".join(f"{f} binary" for f in columns))
    return dealt.groupBy("home").applyInArrow(add, "key long, " + ", ".join(f"{f} long" for f in columns))


def with_customers(words: DataFrame, answers: DataFrame) -> DataFrame:
    """word, c, k, key: ``k`` is how many customers the contexts send to the word restaurant, with
    one table for each pair."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            key = (word_keys(batch.column(0)) >> np.uint64(16)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key)], names=["word", "c", "key"])

    of_bucket = answers.where("shard is null").select("buckets", "words", "counts")
    sent = summed(of_bucket, ["k"], lambda words, counts: (of_six(words), unpacked(counts)))
    known = words.mapInArrow(keyed, "word binary, c long, key long").join(sent, "key", "left")
    return known.select(
        "word", "c", F.when(F.col("c") > 0, F.coalesce("k", F.lit(1))).otherwise(0).cast("long").alias("k"), "key"
    )


def with_tables(words: DataFrame, answers: DataFrame) -> DataFrame:
    """``words`` with ``first``, their customers before any sweep, and ``trail``, what redraws the
    seats in contexts: the tables of the word's own context at first, then for each sweep the
    word's chance before it and its context's tables after it. ``logs``: log10 of these chances."""
    of_bucket = answers.where("shard is null").select("buckets", "contexts", "followers")
    of = summed(of_bucket, ["tables"], lambda contexts, followers: (of_six(contexts), unpacked(followers)))
    trail = F.array(F.coalesce("tables", F.lit(0)).cast("float")).alias("trail")
    return words.join(of, "key", "left").select(
        "word", "c", "k", "key", F.col("k").alias("first"), trail, F.array().cast("array<double>").alias("logs")
    )


def pair_seats(counts, of_word, of_context, contexts, words, discount: float, seed: int):
    """Tables of pairs in their contexts after all sweeps, drawn as each sweep drew them.
    ``of_word``, ``of_context``: a row of the trail for each pair."""
    import numpy as np

    keys = contexts * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xC2B2AE3D27D4EB4F)
    t = np.minimum(counts, 1).astype(np.float64)
    for sweep in range(of_word.shape[1] // 2):
        base, tables = (x[:, 2 * sweep + i].astype(np.float64) for i, x in ((1, of_word), (0, of_context)))
        t = seated(counts, base, discount, 1.0, np.maximum(tables - t, 0), seed + 101 * sweep, keys, own=True)
    return t


def rows_of(lists):
    """A list column of equal lengths as a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def chances(known: DataFrame) -> DataFrame:
    """``known`` with the words' chances (log10p) at the end of their trails."""
    trail = F.concat("trail", F.array(F.pow(F.lit(10.0), "log10p").cast("float"))).alias("trail")
    return known.select("word", "c", "key", "first", trail, F.concat("logs", F.array("log10p")).alias("logs"))


def seats_of(known: DataFrame, answers: DataFrame, discount: float, seed: int) -> DataFrame:
    """A sweep over the pairs, given ``known``: the words with their chances (log10p). Buckets ask
    for the trails of their words and contexts, in blocks, and draw. A row for each shard of a bucket has the
    tables (``seats``) of its pairs that occur again, in its order. One without a shard has the words
    and contexts of the bucket with their tables beyond one a pair: ``customers``, ``tables``."""
    buckets = buckets_of(answers)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for bucket, words, contexts, word, context in zip(*(x.to_pylist() for x in batch.columns)):
                keys = np.union1d(of_six(words)[np.unique(unpacked(word))], of_six(contexts)[np.unique(unpacked_steps(context))])
                names, begins = np.unique(bucket_of(keys, buckets), return_index=True)
                blocks = [six(x) for x in np.split(keys, begins[1:])] if len(names) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([bucket] * len(names), pa.int32()), pa.array(blocks, pa.binary())],
                    names=["home", "bucket", "keys"],
                )

    def reply(asked: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        if not asked.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "trail": pa.array([], pa.binary())})
        keys, at = np.unique(words.column("key").to_numpy().astype(np.uint64), return_index=True)
        trail = rows_of(words.column("trail"))[at]
        found = [packed(trail[np.searchsorted(keys, of_six(x))].T.ravel().view(np.int32)) for x in asked.column("keys").to_pylist()]
        return pa.table({"bucket": asked.column("bucket"), "keys": asked.column("keys"), "trail": pa.array(found, pa.binary())})

    def sit(rows: pa.Table, replies: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        kinds = {"bucket": pa.int32(), "shard": pa.int32(), "buckets": pa.int32(), "seats": pa.binary(), "keys": pa.binary(), "customers": pa.binary(), "tables": pa.binary()}
        own = rows.filter(pc.is_null(rows.column("shard"))).to_pylist()[0]
        rows = rows.filter(pc.is_valid(rows.column("shard")))
        asked = [of_six(x) for x in replies.column("keys").to_pylist()]
        n, word, context = unpacked(own["again_n"]).astype(np.int64), unpacked(own["again_word"]), unpacked_steps(own["again_context"])
        t, more = np.zeros(len(n)), np.zeros((2, 0))
        keys = np.zeros(0, np.uint64)
        if asked:
            keys = np.concatenate(asked)
            order = np.argsort(keys)
            trail = [unpacked(x).view(np.float32).reshape(-1, len(k)).T for x, k in zip(replies.column("trail").to_pylist(), asked)]
            keys, trail = keys[order], np.concatenate(trail)[order]
            word_at, context_at = (
                np.searchsorted(keys, of_six(own[f])[x]) for f, x in (("words", word), ("contexts", context))
            )
            for i in range(0, len(n), 50_000):
                w, c = word_at[i : i + 50_000], context_at[i : i + 50_000]
                t[i : i + 50_000] = pair_seats(n[i : i + 50_000], trail[w], trail[c], keys[c], keys[w], discount, seed)
            more = np.stack([np.bincount(x, t - 1, len(keys)) for x in (word_at, context_at)])
        at = np.flatnonzero(more.any(axis=0))
        k, none = rows.num_rows, [None] * rows.num_rows
        out = {
            "bucket": [own["bucket"]] * (k + 1), "shard": [*rows.column("shard").to_pylist(), None], "buckets": [buckets] * (k + 1),
            "seats": [*(packed(t[unpacked_steps(x)]) for x in rows.column("again").to_pylist()), None],
            "keys": [*none, six(keys[at])], "customers": [*none, packed(more[0, at])], "tables": [*none, packed(more[1, at])],
        }
        return released(pa.table({f: pa.array(out[f], t) for f, t in kinds.items()}))

    asked = answers.where("shard is null").select("bucket", "words", "contexts", "again_word", "again_context").mapInArrow(
        ask, "home int, bucket int, keys binary"
    )
    trails = chances(known).select(bucket_of(F.col("key"), buckets).alias("home"), "key", "trail")
    replies = asked.groupBy("home").cogroup(trails.groupBy("home")).applyInArrow(reply, "bucket int, keys binary, trail binary")
    pairs = answers.select("bucket", "shard", "again", "words", "contexts", "again_n", "again_word", "again_context")
    return pairs.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(
        sit, "bucket int, shard int, buckets int, seats binary, keys binary, customers binary, tables binary"
    )


def swept(known: DataFrame, answers: DataFrame, discount: float, seed: int, seats: DataFrame | None = None) -> DataFrame:
    """``words`` after the sweep over the pairs that gave ``seats``. Each table of a context is a
    customer of the word restaurant."""
    seats = written(seats_of(known, answers, discount, seed), "lm-seats") if seats is None else seats
    of_bucket = seats.where("shard is null").select("buckets", "keys", "customers", "tables")
    sent = summed(of_bucket, ["customers", "tables"], lambda keys, *numbers: (of_six(keys), *map(unpacked, numbers)))
    more = lambda c: F.coalesce(c, F.lit(0))
    after = F.array((F.get("trail", F.lit(0)) + more("tables")).cast("float"))
    return chances(known).join(sent, "key", "left").select(
        "word", "c", F.when(F.col("c") > 0, F.col("first") + more("customers")).otherwise(0).alias("k"), "key", "first",
        F.concat("trail", after).alias("trail"), "logs",
    )


def cells_of(codes: list, sums: list):
    """Distinct codes and their sums."""
    import numpy as np

    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(sums), len(found))


def train(words: DataFrame, n: int, once: int, twice: int, sweeps: int, seed: int) -> tuple[list, float]:
    """The sampled states [(spelling, tables of all words, what the spelling gives to known
    words)] and the discount. ``words``: word, customers (0 for words of held-out texts only)."""
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    seen = words.where("k > 0").select("word", "k")
    states: list = []
    spelling, tables = None, 0.0
    for sweep in range(sweeps + 2):

        def letters(batches: Iterator[pa.RecordBatch], spelling=spelling, tables=tables, sweep=sweep) -> Iterator[pa.RecordBatch]:
            import numpy as np

            seats, mass = 0.0, 0.0
            codes_, sums_ = [np.zeros(0, np.int64)], [np.zeros(0)]
            held = 0
            for batch in batches:
                word, c = batch.column(0), batch.column(1).to_numpy().astype(np.float64)
                t = np.ones(len(c))
                codes, begins = symbols_of(word)
                if spelling is not None:
                    base = np.exp(spelling.log_of(codes, begins))
                    mass += float(base.sum())
                    t = seated(c, base, discount, 1.0, tables, seed + 17 * sweep, word_keys(word))
                codes_.append(codes)
                sums_.append(np.repeat(t, np.diff(np.append(begins, len(codes)))))
                held += len(codes)
                seats += float(t.sum())
                if held > 1_000_000:
                    codes_, sums_ = ([x] for x in cells_of(codes_, sums_))
                    held = 0
            codes_, sums_ = cells_of(codes_, sums_)
            # Code -1 carries the number of tables, -2 what the base gives to known words.
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(codes_, (-1, -2))), pa.array(np.append(sums_, (seats, mass)))], names=["code", "n"]
            )

        # At most 257 ** 3 letters in contexts.
        cells = seen.mapInArrow(letters, "code long, n double").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        import numpy as np

        codes, sums = cells.column("code").to_numpy(), cells.column("n").to_numpy()
        if states:
            states[-1] = (*states[-1][:2], min(1 - 1e-9, float(sums[codes == -2].sum())))
        tables = float(sums[codes == -1].sum())
        spelling = Spelling(codes[codes >= 0], np.rint(sums[codes >= 0]), seed + 1000 * sweep, spelling)
        states.append((spelling, tables, 0.0))
    return states[:-1], discount


def probabilities(words: DataFrame, states: list, discount: float, n: int, seed: int, burn_in: int = 1) -> DataFrame:
    """``words`` (word, c, k, ...) with log10p: predictive probabilities of the word restaurant, with
    ``k`` of all its ``n`` customers on each word, averaged over the sampled states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            word, c = batch.column(0), batch.column(2).to_numpy().astype(np.float64)
            keys, (codes, begins) = word_keys(word), symbols_of(word)
            of = [None] * burn_in + [state[0].log_of(codes, begins) for state in states[burn_in:]]
            logs = []
            for sweep in range(burn_in + 1, len(states)):
                # The seats of this sweep, drawn as they were: against the state before it.
                (_, tables_before, _), (_, tables, mass) = states[sweep - 1], states[sweep]
                t = np.zeros(len(c))
                at = np.flatnonzero(c > 0)
                t[at] = seated(c[at], np.exp(of[sweep - 1])[at], discount, 1.0, tables_before, seed + 17 * sweep, keys[at])
                own = np.maximum(c - discount * t, 0.0)
                spelled = np.where(c > 0, of[sweep], np.log1p(-mass))
                new = np.log(1.0 + discount * tables) + spelled
                logs.append(np.logaddexp(np.log(own, out=np.full(len(c), -np.inf), where=own > 0), new) - np.log(1.0 + n))
            mean = np.logaddexp.reduce(logs, axis=0) - np.log(len(logs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean / np.log(10))], names=[*batch.schema.names, "log10p"])

    return words.mapInArrow(run, T.StructType([*words.schema, T.StructField("log10p", T.DoubleType())]))


def scores(docs: DataFrame, folds: int = 5, held: int = 1, sweeps: int = 3, seed: int = 7, pair_sweeps: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. Each of
    ``pair_sweeps`` sweeps over the pairs leaves a state, below which the other levels are sampled
    in ``sweeps`` sweeps; chances are averaged over these states."""
    sharded = docs.select(
        F.spark_partition_id().alias("shard"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    buckets = min(sharded.rdd.getNumPartitions() or 1, 2**16)
    with shuffles_dropped(docs.sparkSession):
        blocks = written(shard_blocks(sharded), "lm-shards")
        pair_answers = written(merged_pairs(pair_blocks(blocks, buckets)), "lm-pairs")
        pairs = pair_answers.agg(F.coalesce(F.sum("once"), F.lit(0)).alias("once"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice")).first()
        d2 = min(0.95, max(0.05, pairs.once / (pairs.once + 2 * pairs.twice))) if pairs.once else 0.5
        words = written(with_tables(with_customers(counted(pair_answers), pair_answers), pair_answers), "lm-words", "zstd")
        seats: list[DataFrame] = []
        for sweep in range(pair_sweeps + 1):
            of = words.agg(
                F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"),
                F.count_if(F.col("k") == 1).alias("once"), F.count_if(F.col("k") == 2).alias("twice"),
            ).first()
            n, v = int(of.n), int(of.v)
            # Before the first sweep over the pairs there is no state yet, only chances to draw with.
            last, sampled = sweep == pair_sweeps, sweep > 0 or not pair_sweeps
            states, discount = train(words, int(of.k), of.once, of.twice, sweeps if sampled else 1, seed + 7 * sweep)
            known = probabilities(words, states, discount, int(of.k), seed + 7 * sweep, 1 if sampled else 0)
            if not last:
                # The chances must be the same numbers for whoever draws with them.
                known = written(known, "lm-known", "zstd")
                seats.append(written(seats_of(known, pair_answers, d2, seed + 500), "lm-seats"))
                words = written(swept(known, pair_answers, d2, seed + 500, seats[-1]), "lm-words", "zstd")
    # Places in the trails of the states that are averaged.
    kept = list(range(1, pair_sweeps + 1)) or [0]

    def reply(asked: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        order = in_order(words.column("word"), words.column("key"))
        c, order = words.column("c").to_numpy()[order.to_numpy()], order.to_numpy()
        logs, tables = rows_of(words.column("logs")).T[kept][:, order], rows_of(words.column("trail")).T[[2 * i for i in kept]][:, order]
        rows: dict[str, list] = {f: [] for f in ("shard", "bucket", "c", "logs", "tables")}
        for shard, bucket, places in zip(*(x.to_pylist() for x in asked.select(["shard", "bucket", "places"]).columns)):
            at = unpacked_steps(places)
            row = shard, bucket, packed_wide(c[at]), packed_wide(logs[:, at].ravel()), packed(tables[:, at].ravel().view(np.int32))
            for f, x in zip(rows, row):
                rows[f].append(x)
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
        return pa.table({f: pa.array(x, t) for (f, x), t in zip(rows.items(), kinds)})

    of_shards = pair_answers.where("shard is not null")
    by_bucket = known.select(
        bucket_of(F.col("key"), buckets).alias("bucket"), "word", "key", "c", "trail", F.concat("logs", F.array("log10p")).alias("logs")
    )
    replies = of_shards.select("bucket", "shard", "places").groupBy("bucket").cogroup(by_bucket.groupBy("bucket")).applyInArrow(
        reply, "shard int, bucket int, c binary, logs binary, tables binary"
    )
    answers = replies.unionByName(of_shards.select("shard", "bucket", "counts"), allowMissingColumns=True)
    for i, of_sweep in enumerate(seats):
        of_shards = of_sweep.where("shard is not null").select("shard", "bucket", F.col("seats").alias(f"seats{i}"))
        answers = answers.unionByName(of_shards, allowMissingColumns=True)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        import math

        import numpy as np
        import pyarrow.compute as pc

        if not left.num_rows:
            return pa.table({f: pa.array([], t) for f, t in kinds.items()})
        right = right.sort_by("bucket")

        def sent(column: str, read):
            found = right.column(column)
            return np.concatenate([read(x) for x in found.filter(pc.is_valid(found)).to_pylist()], axis=-1)

        def by_state(x, kind):
            return unpacked(x).view(kind).reshape(len(kept), -1)

        c, model, tables, counts = (
            sent("c", lambda x: unpacked(x).view(np.int64)).astype(np.float64),
            10.0 ** sent("logs", lambda x: by_state(x, np.float64)),
            sent("tables", lambda x: by_state(x, np.float32)).astype(np.float64),
            sent("counts", unpacked),
        )
        (row,) = left.to_pylist()
        lengths, seated_at = unpacked(row["lengths"]), []
        for i in range(len(kept)):
            seated_at.append(np.minimum(counts, 1))
            if i < drawn:
                seated_at[i][counts > 1] = sent(f"seats{i}", unpacked)
        line = by_times(unpacked(row.pop("times")))[unpacked(row.pop("ids"))].astype(np.int32)
        own = pair_codes(line, lengths, len(c))
        own.sort()
        own = own[np.append(True, own[1:] != own[:-1])]
        if len(own) != len(counts):
            raise ValueError("a shard's pairs and their counts differ")
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        # A context has as many customers as its word, and in each state the tables of its trail.
        logs = np.empty(len(own))
        for i in range(0, len(own), 100_000):
            part = slice(i, i + 100_000)
            context, word = np.divmod(own[part], len(c))
            p = sum(counts[part] - d2 * t[part] + (1.0 + d2 * of[context]) * chance[word] for t, of, chance in zip(seated_at, tables, model))
            logs[part] = np.log10(p / len(kept) / (1.0 + c[context]))
        rows: dict[str, list] = {f: [] for f in kinds}
        ends = np.cumsum(lengths)
        for doc_id, held_out, size, end in zip(row["doc_ids"], row["held"], lengths.tolist(), ends.tolist()):
            at = line[end - size : end]
            log = logs[np.searchsorted(own, pair_codes(at, [size], len(c)))]
            for f, value in zip(
                kinds,
                (doc_id, held_out, size, int((c[at] > 0).sum()), n, math.fsum(base[at].tolist()), math.fsum(log.tolist())),
            ):
                rows[f].append(value)
        return released(pa.table({f: pa.array(rows[f], t) for f, t in kinds.items()}))

    kinds = {
        "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
        "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(),
    }
    texts = blocks.select("shard", "doc_ids", "held", "lengths", "ids", "times")
    drawn = len(seats)
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, perplexity per token of the model and of the base."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
