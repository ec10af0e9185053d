"""Alignment of two tokenizers over whole documents.

Both tokenizers cut the bytes of a space and the text. Where a token of A and a token of B end
at the same byte, a group ends; every A token of a group is linked with every B token of it. A
pair of ids counts the documents in which it is linked.

Texts become units at spaces where both tokenizers begin anew whatever stands around them, so
that a unit is encoded once and its groups are looked up after that. A document longer than
``chunk_bytes`` is cut into byte ranges dealt over all tasks. A range owns the tokens that end in
it and yields a fragment: an open prefix up to its first common end, closed groups, an open
suffix after its last one. Fragments form a monoid: a suffix and the prefix behind it close a
group, ranges without a common end stay open as a whole. A tree of small groups composes them;
only open ends, counts and the groups on seams travel, the closed groups stay where they are.

Documents lie in blocks of ``block_bytes`` of text, made by the task that read them, with a
dictionary of pairs each. A block sends its pairs with their numbers of documents, gets back the
count of each, and prices its documents' bags of pairs. So what is counted for a very common pair
is one row per block, not one per document.

Defined results: a null or empty text, one that is not valid UTF-8, and one whose A or B tokens
do not spell space+text have no tokens: zeros and an empty column. Rows that repeat a document
are aligned and counted each. A null ``doc_id`` stays null. An empty table gives no rows. Extra
columns are ignored. A unit longer than ``chunk_bytes`` is encoded as a whole, in one task.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetide.llm.common import written
from gazetide.llm.packing import byte_characters

# A space after something that is no space and before an ASCII character that is not white or a
# letter from U+00C0 on: A's pattern begins a new piece there, and no piece of B reaches over it.
CUT = re.compile(rb"(?<=[^ ])(?= [!-~\xc3-\xc9])")
# Units that begin and end so that they may be laid end to end.
REGULAR = re.compile(rb"(?s: [!-~\xc3-\xc9](?:(?!\xe2\x96\x81).)*(?<! ))")
STEP_BYTES = 1 << 20
HUGE = 1 << 12  # links of a group that are expanded one by one
FAN = 16  # fragments composed at once

RECORD = (
    "block long, key long, chunk long, chunks long, doc_id long, ok boolean, n_a long, n_b long, n_groups long,"
    " n_links long, groups_sha256 string, bag binary, times binary, closed binary, codes binary, bounded boolean,"
    " prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>,"
    " pairs binary, documents binary"
)
_KINDS = {
    "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(name) for r in rows], _KINDS[kind]) for name, kind in fields], names=[f[0] for f in fields]
    )


class Fragment(NamedTuple):
    """What is known of a run of byte ranges. ``at`` is the first range with a common end; the
    prefix ends with it. Without any, the prefix holds all tokens. ``seams`` are the groups
    closed between ranges, each with the range before whose closed groups it stands."""

    ok: bool
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    bounded: bool
    at: int
    prefix: tuple
    suffix: tuple
    seams: tuple


def composed(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring runs; associative."""

    def both(x, y):
        return (x[0] + y[0], x[1] + y[1])

    ok = left.ok and right.ok
    if not left.bounded:
        return right._replace(ok=ok, prefix=both(left.prefix, right.prefix))
    if not right.bounded:
        return left._replace(ok=ok, suffix=both(left.suffix, right.prefix))
    a, b = both(left.suffix, right.prefix)
    return Fragment(
        ok,
        left.n_a + right.n_a + len(a),
        left.n_b + right.n_b + len(b),
        left.n_groups + right.n_groups + 1,
        left.n_links + right.n_links + len(a) * len(b),
        True,
        left.at,
        left.prefix,
        right.suffix,
        (*left.seams, (right.at, a, b), *right.seams),
    )


def cut_groups(a: list, b: list):
    """Groups of two lists of (id, end), and the tokens after the last common end."""
    groups, i, j, i0, j0 = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a[i][1] == b[j][1]:
            i, j = i + 1, j + 1
            groups.append(([t for t, _ in a[i0:i]], [t for t, _ in b[j0:j]]))
            i0, j0 = i, j
        elif a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return groups, ([t for t, _ in a[i0:]], [t for t, _ in b[j0:]])


def group_text(groups) -> bytes:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()


class Tokens(NamedTuple):
    """Tokens of units laid end to end: ids and the byte each one ends at, and the units' ends."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    unit_ends: np.ndarray


class Tokenizers:
    """Tokens of units under both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        of_char = {c: bytes([x]) for x, c in byte_characters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = b"".join(of_char.get(c, b"") for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # Decimal digits of every id, one after the other.
        numbers = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.frombuffer(b"".join(numbers), np.uint8)
        self.n_digits = np.array(list(map(len, numbers)))
        self.first_digit = np.cumsum(self.n_digits) - self.n_digits

    def spelled(self, text: bytes) -> tuple | None:
        """(A's, B's) ids of a text that begins with a space; None if either does not spell it."""
        try:
            whole = text.decode()
        except UnicodeDecodeError:
            return None
        a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        b = self.b.encode(whole[1:])
        for ids, parts in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join([parts[i] for i in ids]) != text:
                return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def tokens(self, units: list[bytes]) -> tuple[list[bytes], list[bytes], Tokens]:
        """(units that are spelled, others, tokens of the former laid end to end). Units that
        may follow each other are encoded in one go: their edges are cuts there as well."""
        regular = [u for u in units if REGULAR.fullmatch(u)]
        together = self.spelled(b"".join(regular)) if regular else None
        apart = [u for u in units if not REGULAR.fullmatch(u)] if together else units
        each = [self.spelled(u) for u in apart]
        good = regular * bool(together) + [u for u, x in zip(apart, each) if x]
        found = [x for x in [together, *each] if x]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[side] for x in found)]) for side in (0, 1))
        return good, [u for u, x in zip(apart, each) if not x], Tokens(
            a, np.cumsum(self.a_sizes[a]), b, np.cumsum(self.b_sizes[b]), np.cumsum([len(u) for u in good], dtype=np.int64)
        )

    def group_texts(self, t: Tokens, group_a, group_b) -> list[bytes]:
        """The groups of every unit in decimal."""
        ids, place = np.concatenate((t.a, t.b)), np.concatenate((2 * group_a, 2 * group_b + 1))
        order = np.argsort(place, kind="stable")
        ids, place = ids[order], place[order]
        last = np.append(place[1:] != place[:-1], True)
        after = np.where(last, np.where(place % 2, ord(";"), ord("|")), ord(",")).astype(np.uint8)
        sizes = self.n_digits[ids] + 1
        ends = np.cumsum(sizes)
        line = self.digits[
            np.minimum(np.repeat(self.first_digit[ids] - ends + sizes, sizes) + np.arange(ends[-1]), len(self.digits) - 1)
        ]
        line[ends - 1] = after
        n = np.searchsorted(t.a_ends, t.unit_ends, "right") + np.searchsorted(t.b_ends, t.unit_ends, "right")
        line, stops = line.tobytes(), ends[n - 1].tolist()
        return [line[s : e - 1] for s, e in zip([0, *stops], stops)]


def linked(t: Tokens, group_a, group_b):
    """(index of the A token, code, times) of the linked pairs."""
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    first_b = np.cumsum(n_b) - n_b
    huge = n_a * n_b > HUGE
    n = np.where(huge[group_a], 0, n_b[group_a])
    at_a = np.repeat(np.arange(len(t.a)), n)
    at_b = np.repeat(first_b[group_a] - np.cumsum(n) + n, n) + np.arange(n.sum())
    at, code, times = [at_a], [t.a[at_a] << 32 | t.b[at_b]], [np.ones(len(at_a), np.int64)]
    for g in np.flatnonzero(huge).tolist():  # distinct pairs with their numbers
        first = int(np.searchsorted(group_a, g))
        a, of_a = np.unique(t.a[group_a == g], return_counts=True)
        b, of_b = np.unique(t.b[group_b == g], return_counts=True)
        for x, m in zip(a.tolist(), of_a.tolist()):
            at.append(np.full(len(b), first))
            code.append(x << 32 | b)
            times.append(m * of_b)
    if len(at) > 1:
        at, code, times = (np.concatenate(x) for x in (at, code, times))
        order = np.argsort(at, kind="stable")
        return at[order], code[order], times[order]
    return at[0], code[0], times[0]


class Block:
    """Units and pairs of the documents of one block of text."""

    def __init__(self, tokenizers: Tokenizers, number: int):
        self.tokenizers, self.number = tokenizers, number
        self.unit_of: dict[bytes, int] = {}
        self.bad: set[int] = set()
        self.texts: list[bytes] = []
        self.sizes = [array("q") for _ in range(4)]  # A tokens, B tokens, groups, links
        self.pair_of: dict[int, int] = {}
        self.ends, self.pairs, self.times = array("q"), array("q"), array("q")
        self.documents = np.zeros(0, np.int64)

    def _add(self, names: list[bytes], texts: list[bytes], sizes, ends, codes, times) -> None:
        """More units: their numbers of tokens, groups and links, and where their pairs end."""
        self.unit_of.update(zip(names, range(len(self.texts), len(self.texts) + len(names))))
        self.texts.extend(texts)
        for column, values in zip(self.sizes, sizes):
            column.frombytes(np.asarray(values, np.int64).tobytes())
        distinct, inverse = np.unique(codes, return_inverse=True)
        numbers = [self.pair_of.setdefault(c, len(self.pair_of)) for c in distinct.tolist()]
        self.ends.frombytes((np.asarray(ends, np.int64) + len(self.pairs)).tobytes())
        self.pairs.frombytes(np.array(numbers, np.int64)[inverse].tobytes())
        self.times.frombytes(np.asarray(times, np.int64).tobytes())

    def learn(self, units) -> None:
        """Make sure that all ``units`` have a number."""
        new = [u for u in dict.fromkeys(units) if u not in self.unit_of]
        good, bad, t = self.tokenizers.tokens(new) if new else ([], [], None)
        if good:
            common = np.intersect1d(t.a_ends, t.b_ends, assume_unique=True)
            group_a, group_b = np.searchsorted(common, t.a_ends), np.searchsorted(common, t.b_ends)
            at, codes, times = linked(t, group_a, group_b)
            n = [np.diff(np.searchsorted(x, t.unit_ends, "right"), prepend=0) for x in (t.a_ends, t.b_ends, common)]
            ends = np.searchsorted(at, np.cumsum(n[0]))
            total = np.concatenate(([0], np.cumsum(times)))[ends]
            texts = self.tokenizers.group_texts(t, group_a, group_b)
            self._add(good, texts, [*n, np.diff(total, prepend=0)], ends, codes, times)
        self.bad.update(range(len(self.texts), len(self.texts) + len(bad)))
        if bad:
            none = np.zeros(len(bad), np.int64)
            self._add(bad, [b""] * len(bad), [none] * 4, none, [], [])

    def closed(self, groups) -> list[int]:
        """The number of a run of groups that is no unit, as a list; nothing for no groups."""
        if not groups:
            return []
        name = group_text(groups)  # begins with a digit, units begin with a space
        if name not in self.unit_of:
            links: Counter = Counter()
            for a, b in groups:
                of_b = Counter(b)
                for x, n in Counter(a).items():
                    for y, m in of_b.items():
                        links[x << 32 | y] += n * m
            sizes = [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values())]
            self._add([name], [name], [[n] for n in sizes], [len(links)], list(links), list(links.values()))
        return [self.unit_of[name]]

    def arrays(self):
        """sizes, ends, pairs, times as they are now."""
        ends = np.concatenate(([0], np.array(self.ends, np.int64)))
        return [np.array(c, np.int64) for c in self.sizes], ends, np.array(self.pairs, np.int64), np.array(self.times, np.int64)

    def record(self, numbers, arrays):
        """Counts of a run of units with the bag of their pairs, and its distinct pairs."""
        sizes, ends, pairs, times = arrays
        numbers = np.array(numbers, np.int64)
        n = [int(c[numbers].sum()) for c in sizes]
        first, count = ends[numbers], ends[numbers + 1] - ends[numbers]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        distinct, inverse = np.unique(pairs[at], return_inverse=True)
        total = np.bincount(inverse, times[at], len(distinct)).astype("<u8")
        return {
            "block": self.number, "ok": True, "n_a": n[0], "n_b": n[1], "n_groups": n[2], "n_links": n[3],
            "bag": np.diff(distinct, prepend=0).astype("<u4").tobytes(), "times": total.tobytes(),
        }, distinct

    def count(self, documents) -> None:
        """More documents per pair."""
        documents[: len(self.documents)] += self.documents
        self.documents = documents

    def dictionary(self) -> dict:
        documents = np.zeros(len(self.pair_of), np.int64)
        self.count(documents)
        return {
            "block": self.number,
            "pairs": np.array(list(self.pair_of), "<i8").tobytes(),
            "documents": documents.astype("<u4").tobytes(),
        }


NOTHING = {"ok": False, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "bag": b"", "times": b""}


def whole_documents(block: Block, rows: list[dict], with_groups: bool) -> Iterator[dict]:
    """Records of documents that are one range each."""
    found = [CUT.split(b" " + r["text"]) if r["text"] else [] for r in rows]
    block.learn(u for units in found for u in units)
    arrays = block.arrays()
    documents = np.zeros(len(block.pair_of), np.int64)
    for row, units in zip(rows, found):
        base = {"block": block.number, "chunks": 1, "chunk": 0, "doc_id": row["doc_id"]}
        numbers = [block.unit_of[u] for u in units]
        if not numbers or not block.bad.isdisjoint(numbers):
            yield base | NOTHING
            continue
        record, distinct = block.record(numbers, arrays)
        documents[distinct] += 1
        text = b";".join([block.texts[i] for i in numbers])
        record["groups_sha256"] = hashlib.sha256(text).hexdigest()
        yield base | record | {"closed": text if with_groups else None}
    block.count(documents)


def byte_ranges(block: Block, rows: list[dict]) -> Iterator[dict]:
    """Fragments of byte ranges of long documents. A row has the units that its range touches
    and, in their bytes, the place after which the range begins and the one it ends at."""
    todo = []
    for row in rows:
        units = CUT.split(row["text"])
        ends = np.cumsum([len(u) for u in units]).tolist()
        # Units with an edge inside, and the first one, whose first group is the prefix.
        apart = {0} | ({len(units) - 1} if row["hi"] < ends[-1] else set())
        todo.append((row, units, ends, apart))
    block.learn(u for _, units, _, apart in todo for i, u in enumerate(units) if i not in apart)
    records = []
    for row, units, ends, apart in todo:
        base = {k: row[k] for k in ("key", "chunk", "chunks", "doc_id")} | {"block": block.number}
        cut, middle = {}, [block.unit_of[u] for i, u in enumerate(units) if i not in apart]
        for i in apart:
            good, _, t = block.tokenizers.tokens([units[i]])
            start, sides = ends[i] - len(units[i]), ((t.a, t.a_ends), (t.b, t.b_ends))
            cut[i] = cut_groups(*(
                [(x, start + e) for x, e in zip(ids.tolist(), at.tolist()) if row["lo"] < start + e <= row["hi"]]
                for ids, at in sides
            )) if good else None
        if None in cut.values() or not block.bad.isdisjoint(middle):
            records.append((base | NOTHING | {"bounded": False, "closed": b""}, []))
            continue
        groups, suffix = cut[0]
        open_ends = {"bounded": bool(groups)}
        if groups:
            prefix, numbers = groups[0], block.closed(groups[1:]) + middle
            if len(units) - 1 in apart - {0}:
                last, suffix = cut[len(units) - 1]
                numbers += block.closed(last)
        else:  # one unit, no common end in the range
            prefix, suffix, numbers = suffix, ([], []), []
        for side, at in (("a", 0), ("b", 1)):
            open_ends |= {f"prefix_{side}": prefix[at], f"suffix_{side}": suffix[at]}
        records.append((base | open_ends, numbers))
    arrays, codes = block.arrays(), np.array(list(block.pair_of), "<i8")
    for base, numbers in records:
        if "ok" in base:
            yield base
            continue
        record, distinct = block.record(numbers, arrays)
        closed = b";".join([block.texts[i] for i in numbers])
        yield base | record | {"closed": closed, "codes": codes[distinct].tobytes()}


def encoded(rows: DataFrame, a_path: str, b_path: str, block_bytes: int, branch: int, with_groups: bool = False) -> DataFrame:
    """Records of whole documents (doc_id, text) or of byte ranges, and of their blocks."""
    ranges = "chunk" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_path, b_path)
        first, made, size = (TaskContext.get().partitionId() * 2 + branch) << 32, 0, 0
        block = None
        for batch in batches:
            step = max(1, int(STEP_BYTES / max(1, batch.nbytes / max(1, batch.num_rows))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step).to_pylist()
                if block is None:
                    block, size = Block(tokenizers, first + made), 0
                    made += 1
                made_rows = byte_ranges(block, part) if ranges else whole_documents(block, part, with_groups)
                yield _batch(list(made_rows), RECORD)
                size += sum(len(r["text"] or b"") for r in part)
                if size >= block_bytes:
                    yield _batch([block.dictionary()], RECORD)
                    block = None
        if block is not None:
            yield _batch([block.dictionary()], RECORD)

    return rows.mapInArrow(run, RECORD)


def ranges_of(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """key, doc_id, chunk, chunks, lo, hi and text (the touched units) of the byte ranges of
    long documents. An edge lies at a multiple of ``chunk_bytes``, or behind a unit longer than
    that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "key long, doc_id long, chunk long, chunks long, lo long, hi long, text binary"
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                data = b" " + row["text"]
                cuts = np.array([0, *(m.start() for m in CUT.finditer(data)), len(data)])
                edges = np.arange(chunk_bytes, len(data), chunk_bytes)
                unit = np.searchsorted(cuts, edges, "right") - 1
                wide = cuts[unit + 1] - cuts[unit] > chunk_bytes
                edges = np.unique(np.concatenate(([0], np.where(wide, cuts[unit + 1], edges), [len(data)])))
                start = cuts[np.searchsorted(cuts, edges[:-1], "right") - 1].tolist()
                stop = cuts[np.searchsorted(cuts, edges[1:], "left")].tolist()
                edges = edges.tolist()
                for n, (s, e) in enumerate(zip(start, stop)):
                    yield _batch([{
                        "key": key, "doc_id": row["doc_id"], "chunk": n, "chunks": len(start),
                        "lo": edges[n] - s, "hi": edges[n + 1] - s, "text": data[s:e],
                    }], schema)
                key += 1

    return docs.mapInArrow(run, "key long, doc_id long, chunk long, chunks long, lo long, hi long, text binary")


FRAGMENT = (
    "key long, run long, doc_id long, ok boolean, n_a long, n_b long, n_groups long, n_links long, bounded boolean,"
    " at long, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>,"
    " seams array<struct<at:long,a:array<int>,b:array<int>>>"
)


def reduced(fragments: DataFrame) -> DataFrame:
    """One fragment per document, by a tree whose nodes compose ``FAN`` neighbours each."""
    chunks = fragments.agg(F.max("chunks")).first()[0] or 1
    level = fragments.select(
        "key", F.col("chunk").alias("run"), "doc_id", "ok", "n_a", "n_b", "n_groups", "n_links", "bounded",
        F.col("chunk").alias("at"), "prefix_a", "prefix_b", "suffix_a", "suffix_b",
        F.expr("cast(array() as array<struct<at:bigint,a:array<int>,b:array<int>>>)").alias("seams"),
    )

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["run"])
        whole = functools.reduce(
            composed,
            [
                Fragment(
                    r["ok"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["bounded"], r["at"],
                    (r["prefix_a"] or [], r["prefix_b"] or []), (r["suffix_a"] or [], r["suffix_b"] or []),
                    tuple((s["at"], s["a"], s["b"]) for s in r["seams"]),
                )
                for r in rows
            ],
        )
        out = {
            **{k: rows[0][k] for k in ("key", "run", "doc_id")},
            **{k: getattr(whole, k) for k in ("ok", "n_a", "n_b", "n_groups", "n_links", "bounded", "at")},
            "prefix_a": whole.prefix[0], "prefix_b": whole.prefix[1],
            "suffix_a": whole.suffix[0], "suffix_b": whole.suffix[1],
            "seams": [{"at": at, "a": a, "b": b} for at, a, b in whole.seams],
        }
        out["run"] //= FAN
        return pa.Table.from_pylist([out], table.schema)

    while chunks > 1:
        level = level.groupBy("key", F.floor(F.col("run") / FAN).alias("node")).applyInArrow(
            lambda _, table: compose(table), FRAGMENT
        )
        chunks = -(-chunks // FAN)
    return level


def _unpacked(rows: DataFrame, ids: list[str], column: str, name: str, also: str | None = None) -> DataFrame:
    """One row per number in the binary ``column``, with its place, and the one of ``also``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                values = np.frombuffer(row[column], "<i8")
                more = np.frombuffer(row[also], "<u4").astype(np.int64) if also else np.zeros(len(values), np.int64)
                for a in range(0, len(values), 1 << 18):
                    part = values[a : a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), row[i], np.int64)) for i in ids]
                        + [pa.array(np.arange(a, a + len(part))), pa.array(part), pa.array(more[a : a + len(part)])],
                        names=[*ids, "place", name, "n"],
                    )

    columns = [*ids, column, *([also] if also else [])]
    return rows.select(*columns).mapInArrow(
        run, ", ".join(f"{i} long" for i in ids) + f", place long, {name} long, n long"
    )


def _priced(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links that are the best of their A id, and sums of counts, of a block's documents."""
    count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    place = right.column("place").to_numpy()
    count[place] = right.column("n").to_numpy()
    best[place] = right.column("best").to_numpy(zero_copy_only=False)
    sums = []
    for bag, times in zip(left.column("bag").to_pylist(), left.column("times").to_pylist()):
        pairs = np.cumsum(np.frombuffer(bag, "<u4").astype(np.int64))
        times = np.frombuffer(times, "<u8").astype(np.int64)
        sums.append((int((best[pairs] * times).sum()), int((count[pairs] * times).sum())))
    kept = left.select(["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array([s[0] for s in sums], pa.int64())).append_column(
        "count_sum", pa.array([s[1] for s in sums], pa.int64())
    )


def _hashes(parts: DataFrame) -> DataFrame:
    """key and groups_sha256 of parts (key, chunk, ord, closed), which are read in order and
    never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append({"key": key, "groups_sha256": digest.hexdigest()})
                    key, digest = k, hashlib.sha256(part)
                else:
                    digest.update(b";" + part)
            yield _batch(done, "key long, groups_sha256 string")
        if key is not None:
            yield _batch([{"key": key, "groups_sha256": digest.hexdigest()}], "key long, groups_sha256 string")

    order = ["key", "chunk", "ord"]
    rows = parts.repartition("key").sortWithinPartitions(*order).select("key", "closed")
    return rows.mapInArrow(run, "key long, groups_sha256 string")


class Aligned(NamedTuple):
    documents: DataFrame  # doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    pairs: DataFrame  # a_id, b_id, documents, best
    records: DataFrame  # with_groups: ``closed`` holds the groups of documents of one range


def aligned(
    docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = 1 << 16, block_bytes: int = 8 << 20,
    with_groups: bool = False,
) -> Aligned:
    """Alignment of all ``docs`` (doc_id, text) under a byte-level BPE file and a sentencepiece
    model."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= chunk_bytes, F.lit(False))
    short = written(encoded(texts.where(~is_long), a_path, b_path, block_bytes, 0, with_groups), "align-short", "zstd")
    # Only long documents are dealt over the tasks.
    ranges = ranges_of(texts.where(is_long), chunk_bytes).repartition("key", "chunk")
    ranged = written(encoded(ranges, a_path, b_path, block_bytes, 1), "align-ranges", "zstd")

    fragments = ranged.where("pairs is null")
    whole = written(reduced(fragments), "align-reduced")
    # What stands before the first common end is a group as well, now that nothing precedes it.
    first = F.array(F.struct(F.col("at"), F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b")))
    seams = whole.where("ok").select("key", F.inline(F.concat(first, "seams")))
    seam_links = (
        seams.select("key", "b", F.explode("a").alias("a_id"))
        .select("key", "a_id", F.explode("b").alias("b_id"))
        .groupBy("key", (F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("code"))
        .agg(F.count("*").alias("links"))
    )
    good = whole.where("ok").select("key")
    long_pairs = (
        _unpacked(fragments.where("ok"), ["key"], "codes", "code").select("key", "code")
        .join(good, "key", "left_semi")
        .union(seam_links.select("key", "code"))
        .distinct()
        .groupBy("code").agg(F.count("*").alias("n"))
    )

    books = short.where("pairs is not null").unionByName(ranged.where("pairs is not null"))
    book_pairs = _unpacked(books, ["block"], "pairs", "code", "documents")
    counts = book_pairs.select("code", "n").union(long_pairs).groupBy("code").agg(F.sum("n").alias("n")).where("n > 0")
    counts = written(counts, "align-counts")
    top = counts.groupBy(F.shiftright("code", 32).alias("a_id")).agg(F.max("n").alias("top"))
    priced = (
        counts.withColumn("a_id", F.shiftright("code", 32))
        .join(top, "a_id")
        .select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    )
    answers = book_pairs.select("block", "place", "code").join(priced, "code", "left").select(
        "block", "place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(False)).alias("best")
    )
    sums = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    bags = short.unionByName(ranged).where("pairs is null").select(
        "block", "key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "bag", "times"
    )
    per_range = bags.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_priced, sums)
    per_range = written(per_range, "align-priced")
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    on_seams = seam_links.join(priced, "code").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"),
    )
    long_sums = (
        per_range.where("key is not null").select("key", "n_best", "count_sum").union(on_seams)
        .groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    seam_text = F.concat_ws("|", F.array_join("a", ","), F.array_join("b", ",")).cast("binary")
    parts = fragments.where("ok and length(closed) > 0").select("key", "chunk", F.lit(1).alias("ord"), "closed").unionByName(
        seams.select("key", F.col("at").alias("chunk"), F.lit(0).alias("ord"), seam_text.alias("closed"))
    )
    prefix_a, prefix_b = F.size("prefix_a"), F.size("prefix_b")
    totals = whole.select(
        "key", "doc_id", "ok",
        (F.col("n_a") + prefix_a).alias("n_a"), (F.col("n_b") + prefix_b).alias("n_b"),
        (F.col("n_groups") + 1).alias("n_groups"),
        (F.col("n_links") + prefix_a.cast("long") * prefix_b).alias("n_links"),
    )
    long_docs = totals.join(long_sums, "key", "left").join(_hashes(parts), "key", "left")

    def if_ok(name, otherwise):
        return F.when(F.col("ok"), F.col(name)).otherwise(otherwise).alias(name)

    long_docs = long_docs.select(
        "doc_id", *[if_ok(c, F.lit(0).cast("long")) for c in result[1:-1]], if_ok("groups_sha256", F.lit(""))
    )
    pairs = priced.select(
        F.shiftright("code", 32).cast("int").alias("a_id"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"),
        F.col("n").alias("documents"), "best",
    )
    short_docs = per_range.where("key is null").select(*result)
    return Aligned(short_docs.unionByName(long_docs), pairs, short)
