"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; every query block meets every candidate block as
one tile. In a tile, unit vectors become int8 codes with a scale and the length of what rounding
lost; one integer product gives all cosines within proven bounds. Pairs whose upper bound
reaches the k-th lower bound survive, are recomputed in double precision from the original
vectors, and k per query leave the tile in heap order. The tiles' lists are merged by heaps.
The result is exact: bounds only skip pairs that cannot be among the k nearest.

A row is copied once per block of the other side, blocks are filled by a hash of the id, so equal
or very common vectors spread, and a tile's size does not grow with the table.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do rows with a null id. Vectors of different lengths are not compared. Of rows that
repeat an id, the first in the order of components counts. Ties go to the smaller id. With no
candidates a query has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP = 128


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(unit):
    """(codes, scale, length of the rounding error) of unit vectors, by row."""
    import numpy as np

    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


def integer_product(a, b):
    """Exact products of int8 rows: float32 holds every partial sum of 1,024 of them."""
    import numpy as np

    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        total += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return total


def in_order(a, b):
    """Sums of products by row, component after component, so that equal vectors give equal sums."""
    import numpy as np

    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def tile_nearest(q_ids, q, c_ids, c, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine): the k nearest candidates of the tile, for each query."""
    import numpy as np

    squares_q, squares_c = in_order(q, q), in_order(c, c)
    codes_q, scale_q, lost_q = quantised(q / np.sqrt(squares_q)[:, None])
    codes_c, scale_c, lost_c = quantised(c / np.sqrt(squares_c)[:, None])
    out = []
    for at in range(0, len(q), STRIP):
        rows = slice(at, at + STRIP)
        near = integer_product(codes_q[rows], codes_c) * scale_q[rows, None] * scale_c[None, :]
        # |xy - x'y'| <= |x - x'| |y| + |x'| |y - y'|, and a little for the doubles.
        bound = lost_q[rows, None] + (1 + lost_q[rows, None]) * lost_c[None, :] + 1e-9
        own = q_ids[rows, None] == c_ids[None, :]
        low, high = np.where(own, -np.inf, near - bound), np.where(own, -np.inf, near + bound)
        least = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(low), -np.inf)
        for i in range(len(low)):
            alive = np.flatnonzero((high[i] >= least[i]) & (high[i] > -np.inf))
            if not len(alive):
                continue
            dots = in_order(np.broadcast_to(q[at + i], (len(alive), q.shape[1])), c[alive])
            scores = np.clip(dots / np.sqrt(squares_q[at + i] * squares_c[alive]), -1.0, 1.0)
            best = heapq.nsmallest(k, zip((-scores).tolist(), c_ids[alive].tolist()))
            out += [(int(q_ids[at + i]), j, -s) for s, j in best]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = 2048, block: int = 1024) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k nearest other rows of each query."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        is_query.alias("is_query"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    q_blocks, c_blocks = max(1, -(-sizes.q // query_block)), max(1, -(-sizes.n // block))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other),
            "vec_id", "embedding",
        )

    queries = dealt(rows.where("is_query"), "i", q_blocks, "j", c_blocks)
    candidates = dealt(rows, "j", c_blocks, "i", q_blocks)

    def vectors_of(part: pa.Table) -> dict[int, tuple]:
        """By dimension: ids and vectors as arrays, one row for each id."""
        import numpy as np

        ids = part.column("vec_id").to_numpy()
        lists = part.column("embedding").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        rows: dict[int, int] = {}
        for at, i in enumerate(ids.tolist()):
            if i not in rows or tuple(values[ends[at] : ends[at + 1]]) < tuple(values[ends[rows[i]] : ends[rows[i] + 1]]):
                rows[i] = at
        kept = np.array(sorted(rows.values()), np.int64)
        sizes = np.diff(ends)[kept]
        return {
            int(d): (ids[kept[sizes == d]], np.stack([values[ends[a] : ends[a + 1]] for a in kept[sizes == d]]).astype(float))
            for d in np.unique(sizes)
        }

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, c = vectors_of(left), vectors_of(right)
            for d in q.keys() & c.keys():
                out += tile_nearest(*q[d], *c[d], k)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    lists = queries.groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(
        tile, "query_id long, vec_id long, score double"
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by query: one heap at a time, its worst on top."""
        current, heap = None, []

        def done():
            best = sorted(heap, reverse=True)
            return [(current, rank, -minus, score) for rank, (score, minus) in enumerate(best, 1)]

        def batch_of(out):
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["query_id", "rank", "vec_id", "score"]
            )

        for batch in batches:
            out = []
            for query, vec, score in zip(*(c.to_pylist() for c in batch.columns)):
                if query != current:
                    out += done()
                    current, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
            yield batch_of(out)
        yield batch_of(done())

    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        merge, "query_id long, rank int, vec_id long, score double"
    )
