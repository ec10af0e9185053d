"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's shingles are thrown into the bins of its sketch round by round: in the first
rounds a hash picks the bin, in the later ones round ``t + b`` puts every shingle into bin
``b``, so all ``t`` bins are filled after ``2 t`` rounds at the latest. A bin keeps the smallest
(round, hash), and two sketches agree in a bin with a probability equal to the similarity,
sharply concentrated because one shingle fills few bins. ``bands`` groups of ``rows`` bins
become band keys; two documents that share one are candidates.

Copies fold first: documents with equal shingle sets form a class, and only its smallest id goes
on. Candidates are found without listing the pairs of a bucket. First every member is confirmed
against pivots, the members with most company; components follow from the links. Only what a
bucket then still holds of several components is compared in full: in a small bucket as pairs
whose lengths can reach the threshold, in a large one tile by tile, where pairs stay inside the
task. Links are confirmed on full sets. Two documents of one bucket are thus in one component or
compared, and at 0.8 similarity 32 bands of 4 leave a pair without a bucket with probability
(1 - 0.8**4)**32, below 1e-7.

Pairs whose lengths rule a link out are dropped unseen. For the others the texts travel, once per
pair in compressed shuffles, and sets are made where both meet; nothing of their size is stored.

Defined results: null and empty texts have no shingles and stand alone. Rows with a null id
stand alone, with a null component, and are kept. Rows that repeat an id are each judged by their
own text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazetide.llm.common import unused
from gazetide.llm.components import connected_components
from gazetide.session import cut_lineage

MASK = (1 << 64) - 1


def mixed(x):
    """A 64-bit finaliser over a uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    REMEMBERED = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words_of: WordHashes, k: int):
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text is one shingle. Words
    are what ASCII white space divides, with A-Z lower-cased."""
    import numpy as np

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - n + 1 + j])
    return np.unique(out)


def sketch(shingles, t: int):
    """The fast similarity sketch: one uint64 per bin, of (round, hash of that round)."""
    import numpy as np

    bins = np.full(t, MASK, np.uint64)
    done, step = 0, max(1, 4 * t // len(shingles))
    while done < 2 * t:
        rounds = np.arange(done, min(done + step, 2 * t), dtype=np.uint64)
        values = mixed(shingles[None, :] ^ mixed(rounds + np.uint64(0x51ED2701))[:, None])
        places = np.where(
            rounds[:, None] < t, values % np.uint64(t), np.maximum(rounds, np.uint64(t))[:, None] - np.uint64(t)
        )
        np.minimum.at(bins, places.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(54)) | (values >> np.uint64(10))).ravel())
        if bins.max() != MASK:
            break
        done += step
    return bins


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash (null without words), keys array<long>: one per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        words_of = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, hashes, keys, ends = [], [], [], [0]
                for text in part.column(1):
                    shingles = shingle_set(text.as_py(), words_of, k)
                    sizes.append(len(shingles))
                    if len(shingles):
                        hashes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                        of_band = sketch(shingles, bands * rows).reshape(bands, rows)
                        key = np.arange(bands, dtype=np.uint64)
                        for j in range(rows):
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + of_band[:, j])
                        keys.append(key.view(np.int64))
                    else:
                        hashes.append(None)
                    ends.append(ends[-1] + bands * (len(shingles) > 0))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(sizes, pa.int64()),
                        pa.array(hashes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_hash", "keys"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, set_hash binary, keys array<long>"
    )


BITMAP = 1 << 20


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of ``wanted`` (doc_id, ...) for its documents. A bitmap
    of fixed size drops most texts of other documents before they are shuffled, as long as
    ``wanted`` is small against it; the join decides."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    words = (
        wanted.groupBy(F.floor(place / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
        .collect()
    )  # at most BITMAP / 64 rows
    bits = dict(map(tuple, words))
    if len(bits) < BITMAP // 64:  # every word taken: nothing would be dropped
        line = ",".join(str(bits.get(i, 0)) for i in range(BITMAP // 64))
        word = F.get(F.split(F.lit(line), ",").cast("array<bigint>"), F.floor(place / 64).cast("int"))
        texts = texts.where(F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(1) == 1)
    return texts.join(wanted, "doc_id")


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """``texts`` (id, text, more longs) with ``shingles`` array<long> in place of the text."""
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words_of = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(text.as_py(), words_of, k).view(np.int64) for text in part.column(len(others))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    names=[*others, "shingles"],
                )

    return texts.select(*others, "text").mapInArrow(
        run, ", ".join(f"{c} long" for c in others) + ", shingles array<long>"
    )


def can_link(n: str, m: str, percent: int) -> Column:
    """Whether sets of so many shingles can reach ``percent`` of their union at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def similar(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a``, ``b`` of the rows (a, b, of_a, of_b) whose two texts' sets reach ``percent`` of
    their union. The set of a text that stands in several rows in a row is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words_of = WordHashes()
        last, left = None, None
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (one, other) in enumerate(zip(batch.column(2), batch.column(3))):
                if last is None or not one.equals(last):
                    last, left = one, shingle_set(one.as_py(), words_of, k)
                right = shingle_set(other.as_py(), words_of, k)
                if len(left) and len(right):
                    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                    both = int((left[at] == right).sum())
                    linked[i] = 100 * both >= percent * (len(left) + len(right) - both)
            yield batch.select([0, 1]).filter(pa.array(linked))

    return texts.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets reach ``percent`` of their union. Texts are shuffled
    once by their id, where those of ``a`` stay, and once more with each partner as those of ``b``:
    compressed, a text is far smaller than its set of hashes."""
    pairs = cut_lineage(pairs)
    if pairs.isEmpty():
        return pairs
    partners = (
        pairs.select(F.col("b").alias("doc_id"), "a")
        .union(pairs.select(F.col("a").alias("doc_id"), F.lit(None).cast("long").alias("a")).distinct())
        .groupBy("doc_id")
        .agg(F.collect_list("a").alias("partners"), F.count_if(F.col("a").isNull()).alias("asked"))
    )
    texts = texts_of(docs, cut_lineage(partners))
    left = texts.where("asked > 0").select(F.col("doc_id").alias("a"), F.col("text").alias("of_a"))
    right = texts.select(F.explode("partners").alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("of_b"))
    return cut_lineage(similar(right.join(left, "a"), k, percent))


SMALL, TILE, COLUMNS = 32, 512, 4096


def tile_links(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` across components in large buckets (key, id, component, c). A
    bucket's members are dealt into blocks of about ``TILE`` and every two blocks meet in
    a task of their own, where intersections come from products of incidence tiles. No pair leaves
    a task but links that join two components there, fewer than the task has members."""
    if members.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = full_sets(texts_of(docs, members.select(F.col("id").alias("doc_id")).distinct()), k)
    blocks = F.ceil(F.col("c") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), blocks).cast("int")
    placed = members.select("key", "id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiles = placed.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", F.col("id").alias("doc_id")
    ).join(sets, "doc_id")

    def compare(tile: pa.Table) -> pa.Table:
        import numpy as np

        tile = tile.combine_chunks().sort_by("doc_id")
        ids, component, own = (tile.column(c).to_numpy() for c in ("doc_id", "component", "own"))
        lists = tile.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy()
        sizes, values = np.diff(ends), lists.flatten().to_numpy()
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        row, column = np.repeat(np.arange(len(ids)), sizes)[count[column] > 1], number[column[count[column] > 1]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        width = int(number[-1]) + 1 if len(number) else 0
        for at in range(0, width, COLUMNS):
            low, high = np.searchsorted(column, (at, at + COLUMNS))
            cells = np.zeros((len(ids), COLUMNS), np.float32)
            cells[row[low:high], column[low:high] - at] = 1
            both += cells @ cells.T
        both = both.astype(np.int64)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        if tile.column("i")[0] != tile.column("j")[0]:
            linked &= own[:, None] != own[None, :]
        found = []
        root = {c: c for c in component.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for x, y in np.argwhere(np.triu(linked & (component[:, None] != component[None, :]), 1)).tolist():
            u, v = top(int(component[x])), top(int(component[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                found.append((int(ids[x]), int(ids[y])))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return cut_lineage(tiles.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))


def link_table(docs: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """``node``, ``component`` of all class heads that have a link."""
    heads = sketched.where("doc_id is not null and set_hash is not null").groupBy("set_hash").agg(
        F.min("doc_id").alias("doc_id")
    )
    members = sketched.join(heads, ["doc_id", "set_hash"], "left_semi").select(
        F.col("doc_id").alias("id"), "n_shingles", F.explode("keys").alias("key")
    )
    shared = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = cut_lineage(members.join(shared, "key"))
    # The pivot of a bucket: its member with the most company over all its buckets.
    company = buckets.groupBy("id").agg(F.sum("c").alias("company"))
    pivots = (
        buckets.join(company, "id")
        .groupBy("key")
        .agg(F.max(F.struct("company", F.negative("id").alias("minus"), "n_shingles")).alias("best"))
        .select("key", (-F.col("best")["minus"]).alias("pivot"), F.col("best")["n_shingles"].alias("of_pivot"))
    )
    votes = cut_lineage(
        buckets.join(pivots, "key")
        .where((F.col("id") != F.col("pivot")) & can_link("n_shingles", "of_pivot", percent))
        .groupBy("id", "pivot")
        .agg(F.count("*").alias("n"))
    )
    # First every member against the pivot it meets most, then against its other pivots where
    # the two are still apart.
    best = votes.groupBy("id").agg(F.max(F.struct("n", F.negative("pivot").alias("minus"))).alias("best"))
    stars = best.select((-F.col("best")["minus"]).alias("a"), F.col("id").alias("b"))
    links = confirmed(stars, docs, k, percent)
    labels = connected_components(links)

    def labelled(rows: DataFrame, column: str, to: str) -> DataFrame:
        found = rows.join(labels.select(F.col("node").alias(column), F.col("component").alias(to)), column, "left")
        return found.withColumn(to, F.coalesce(to, column))

    apart = labelled(labelled(votes, "id", "of_id"), "pivot", "of_pivot").where("of_id <> of_pivot")
    tested = stars.select(F.col("a").alias("pivot"), F.col("b").alias("id"))
    more = confirmed(
        apart.join(tested, ["id", "pivot"], "left_anti").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(),
        docs, k, percent,
    )
    if not more.isEmpty():
        links = cut_lineage(links.union(more))
        labels = connected_components(links)
    # What a bucket still holds of several components is compared in full.
    open_ = labelled(buckets, "id", "component")
    split = open_.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = cut_lineage(open_.join(split.select("key"), "key", "left_semi"))
    few = left.where(F.col("c") <= SMALL)
    right = few.select(
        "key", F.col("id").alias("id2"), F.col("n_shingles").alias("n2"), F.col("component").alias("component2")
    )
    across = (
        few.join(right, "key")
        .where(
            (F.col("component") < F.col("component2")) & can_link("n_shingles", "n2", percent)
        )
        .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        .distinct()
    )
    rest = confirmed(across, docs, k, percent).union(tile_links(left.where(F.col("c") > SMALL), docs, k, percent))
    if rest.isEmpty():
        return labels
    return connected_components(links.union(rest))


def judged_rows(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash, component_id and kept for every row."""
    sketched = cut_lineage(sketches(docs, k, bands, rows))
    labels = link_table(docs, sketched, k, percent)
    heads = (
        sketched.where("doc_id is not null and set_hash is not null")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("head"))
        .join(labels.withColumnRenamed("node", "head"), "head", "left")
        .select("set_hash", F.coalesce("component", "head").alias("component_id"))
    )
    apart = F.col("doc_id").isNull() | F.col("set_hash").isNull()
    columns = ["doc_id", "text_key", "n_shingles", "set_hash"]
    linked = sketched.where(~apart).select(*columns).join(heads, "set_hash", "left")
    out = linked.select(*columns, "component_id").union(
        sketched.where(apart).select(*columns, F.col("doc_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``."""
    return judged_rows(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """``docs`` with one row of each group: the smallest id. A row is judged by its own text, so
    of rows that repeat an id some may go and others stay; of rows equal in id and words one
    stays, the one whose text has the smallest hash. Rows without an id stay. That is decided on
    narrow rows; texts are shuffled once."""
    names = docs.columns
    id_, key, row = (unused(docs, f"__{x}") for x in ("id", "key", "row"))
    kept = (
        judged_rows(docs, k, percent, bands, rows)
        .where("kept and doc_id is not null")
        .withColumn("text_key", F.coalesce("text_key", F.lit(0)))
        .groupBy(F.col("doc_id").alias(id_), F.coalesce("set_hash", F.col("text_key").cast("string").cast("binary")))
        .agg(F.min("text_key").alias(key))
        .select(id_, key)
    )
    text_key = F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    return (
        docs.withColumns({id_: F.col("doc_id").cast("long"), key: text_key})
        .join(kept, [id_, key], "left_semi")
        .withColumn(row, F.row_number().over(Window.partitionBy(id_, key).orderBy(id_)))
        .where(F.col(row) == 1)
        .select(names)
        .union(docs.where("doc_id is null").select(names))
    )
