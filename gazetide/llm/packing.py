"""Packing by concatenate-and-cut.

All documents are laid end to end on one token line, in the order of the scan's partitions and
of the rows in them, and the line is cut every ``capacity`` tokens. Pass one tokenises once and
writes each document's ids with its offset inside its partition; the totals per partition, one
number per task, give every partition its place on the line. Pass two adds that base and cuts.
No row is shuffled; only windows that reach over a partition's edge are put together by a
grouping of at most two records per partition.

Defined results: a null or empty text is the closing id alone. Rows that repeat a document are
packed each. A null ``doc_id`` stays null. An empty table gives no pieces. Extra columns are
ignored. A document longer than a window is cut into as many pieces as it needs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetide.llm.common import written

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder:
    """Ids of a byte-level BPE tokenizer file, for a batch of texts at once.

    Its pre-tokenizer begins a new piece at every single space that is followed by a
    character that is no white space. Texts are cut there, each distinct unit of a batch is
    encoded once, and the ids are gathered back. Texts with characters on which the two
    libraries' patterns might differ, or with an added token in them, go to the tokenizer
    itself as a whole."""

    WIDTH = 16  # units of up to so many bytes are told apart as numbers

    def __init__(self, path: str):
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        of_char = {c: bytes([b]) for b, c in byte_characters().items()}
        ranks = {
            b"".join(of_char[c] for c in token): i
            for token, i in self.whole.get_vocab(with_added_tokens=False).items()
            if all(c in of_char for c in token)
        }
        self.core = tiktoken.Encoding(
            "pieces",
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks=ranks,
            special_tokens={},
        )
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        # Tab, line ends, printable ASCII, and letters up to U+024F after the space at U+00A0.
        self.plain = np.zeros(256, bool)
        self.plain[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC2, 0xCA)]] = True
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 13, 32]] = True

    def encode(self, texts: pa.Array, end: int):
        """(ids of all texts laid end to end as uint32, tokens of each text); each text is
        followed by the id ``end``."""
        import numpy as np

        offsets, data = text_buffers(texts)
        n_texts, stop = len(texts), int(offsets[-1])
        lengths = np.diff(offsets)
        # Cuts: the text starts, and single spaces before something that is not white.
        following = np.append(data[1:], 32) if len(data) else data
        odd = ~self.plain[data]
        odd |= (data == 0xC2) & (following <= 0xA0) & (following >= 0x80)
        odd_before = np.concatenate(([0], np.cumsum(odd)))
        special = odd_before[offsets[1:]] > odd_before[offsets[:-1]]
        cut = (data == 32) & ~self.white[following]
        last = offsets[1:][lengths > 0] - 1
        cut[last] = False
        heads = offsets[:-1][lengths > 0]
        if any(a in (blob := data.tobytes()) for a in self.added):
            for i in range(n_texts):
                special[i] |= any(a in blob[offsets[i] : offsets[i + 1]] for a in self.added)
        cut[heads] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, stop))
        owner = np.repeat(np.arange(n_texts), np.diff(np.searchsorted(starts, offsets)))
        kept = ~special[owner]
        starts, sizes, owner = starts[kept], sizes[kept], owner[kept]
        head = np.isin(starts, heads, assume_unique=True)
        short = ~head & (sizes <= self.WIDTH)
        pool: list = []  # arrays of ids
        place = np.zeros(len(starts), np.int64)
        count = np.zeros(len(starts), np.int64)
        total = 0

        def add(where, ids, ends, inverse=None):
            nonlocal total
            begins = np.concatenate(([0], ends[:-1]))
            counts = ends - begins
            place[where] = total + (begins if inverse is None else begins[inverse])
            count[where] = counts if inverse is None else counts[inverse]
            pool.append(ids)
            total += len(ids)

        if short.any():
            first, inverse = distinct(data, starts[short], sizes[short], self.WIDTH)
            at, size = starts[short][first], sizes[short][first]
            line = data[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()
            add(short, *self._divided(line, size), inverse)
        long = np.flatnonzero(~short & ~head)
        if len(long):
            line = b"".join(data[s : s + n].tobytes() for s, n in zip(starts[long].tolist(), sizes[long].tolist()))
            add(long, *self._divided(line, sizes[long]))
        at_head = np.flatnonzero(head)
        if len(at_head):
            each = [
                self.core.encode_ordinary(data[s : s + n].tobytes().decode())
                for s, n in zip(starts[at_head].tolist(), sizes[at_head].tolist())
            ]
            add(at_head, np.array([i for x in each for i in x], "<u4"), np.cumsum([len(x) for x in each]))
        for i in np.flatnonzero(special).tolist():
            ids = self.whole.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids
            pool.append(np.array(ids, "<u4"))
            owner, place, count = (np.append(x, v) for x, v in ((owner, i), (place, total), (count, len(ids))))
            total += len(ids)
        # The closing id of every text comes after its units.
        pool.append(np.array([end], "<u4"))
        owner = np.append(owner, np.arange(n_texts))
        place = np.append(place, np.full(n_texts, total))
        count = np.append(count, np.ones(n_texts, np.int64))
        order = np.argsort(owner, kind="stable")
        owner, place, count = owner[order], place[order], count[order]
        ids = np.concatenate(pool)[np.repeat(place - np.cumsum(count) + count, count) + np.arange(count.sum())]
        return ids, np.bincount(owner, count, n_texts).astype(np.int64)

    def _divided(self, line: bytes, sizes):
        """Ids of units laid end to end, and where each unit's ids end."""
        import numpy as np

        ids = np.array(self.core.encode_ordinary(line.decode()), "<u4")
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1


def text_buffers(texts: pa.Array):
    """(offsets int64, bytes uint8) of a string array; a null is an empty text."""
    import numpy as np

    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def distinct(data, starts, sizes, width: int):
    """(index of one of each distinct unit, and for every unit the number of its own)."""
    import numpy as np

    padded = np.append(data, np.zeros(width + 8, np.uint8))
    eight = np.ndarray((len(data) + width,), "<u8", padded, strides=(1,))  # the 8 bytes from each place
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    words = np.stack(
        [eight[starts + j] & masks[np.clip(sizes - j, 0, 8)] for j in range(0, width, 8)], axis=1
    )
    mixed = words[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for j in range(1, words.shape[1]):
        mixed = (mixed + words[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    if not (words[first[inverse]] == words).all():  # two units with one mix
        _, first, inverse = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable bytes stand
    for themselves, the others for the characters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return {b: chr(b if b in own else next(others)) for b in range(256)}


STEP_BYTES = 2 << 20


def in_steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``STEP_BYTES``, so that memory follows the longest text at most."""
    rows = max(1, int(STEP_BYTES / max(1, batch.nbytes / max(1, batch.num_rows))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tokenized(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """part int, doc_id long, before long (tokens of the partition's earlier documents),
    n long, ids binary: pass one, written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, part, before = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in in_steps(batch):
                ids, n = encoder.encode(rows.column(1), end)
                ends = np.cumsum(n)
                starts = before + ends - n
                before += int(n.sum())
                blob, ends = ids.tobytes(), ends.tolist()
                ids = [blob[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)),
                        rows.column(0),
                        pa.array(starts),
                        pa.array(n),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "doc_id", "before", "n", "ids"],
                )

    return written(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            encode, "part int, doc_id long, before long, n long, ids binary"
        ),
        "packing",
    )


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 1024) -> DataFrame:
    """The pieces of all documents: ``doc_id``, ``start`` and ``length`` in the document's own
    tokens, ``doc_tokens`` with the closing id, ``sequence_id`` and ``offset`` of the window,
    and the piece's ``ids`` (little-endian uint32)."""
    lines = tokenized(docs, tokenizer, end)
    # One number per task of pass one: the driver keeps more than that about each task.
    totals = {r.part: r.total for r in lines.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    order = sorted(totals)
    base = dict(zip(order, itertools.accumulate((totals[p] for p in order), initial=0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[tuple] = []
                for part, doc_id, before, n, ids in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    place, start = base[part] + before, 0
                    while start < n:
                        sequence, offset = divmod(place + start, capacity)
                        length = min(n - start, capacity - offset)
                        out.append((doc_id, start, length, n, sequence, offset, ids[4 * start : 4 * (start + length)]))
                        start += length
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return lines.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, capacity: int = 1024, pad: int = 0) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and padded ``ids`` of every window. Pieces lie in order in
    their tasks, so all windows but the first and last of a task are put together in place;
    only those boundary records meet by a shuffle."""
    inside = pieces.select("sequence_id", "offset", "ids")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, offset, parts = None, 0, []

        def record():
            blob = b"".join(parts)
            return (current, offset, blob)

        for batch in batches:
            out = []
            for sequence, at, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (sequence != current or at != offset + sum(map(len, parts)) // 4):
                    out.append(record())
                    parts = []
                if not parts:
                    current, offset = sequence, at
                parts.append(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                names=["sequence_id", "offset", "ids"],
            )
        if parts:
            last = record()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(last, (pa.int64(), pa.int64(), pa.binary()))],
                names=["sequence_id", "offset", "ids"],
            )

    runs = inside.mapInArrow(join, "sequence_id long, offset long, ids binary")
    full = F.length("ids") == 4 * capacity
    whole = runs.where(full).select("sequence_id", "ids")
    edges = (
        runs.where(~full)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("runs"))
        .select(
            "sequence_id",
            F.aggregate("runs", F.lit(b""), lambda line, run: F.concat(line, run["ids"])).alias("ids"),
        )
    )
    padding = F.repeat(F.lit(pad.to_bytes(4, "little").hex()), capacity)
    return whole.unionByName(edges).select(
        "sequence_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.substring(F.concat("ids", F.unhex(padding)), 1, 4 * capacity).alias("ids"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
