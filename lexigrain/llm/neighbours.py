"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are dealt into blocks of bounded size, and each block has a forest of
its own, built once.  A tree gives each vector a long hash string and keeps the
strings as one sorted array.  A bit of the string tells on which side of a
plane the vector lies; the plane stands halfway between two vectors drawn from
the block, so it follows both angle and length.  A query descends each tree to
its longest match: its place in the sorted array.  Then all trees ascend
together, one prefix bit at a time, each taking in the run of strings that
share the shorter prefix, until the trees together hold enough different
candidates.  Those are measured exactly, and the best of all blocks are the
answer.

How many candidates are enough depends on the vectors: in clusters a few in a
hundred hold the answers, random directions in 64 dimensions need far more.  So
each block asks ``probes`` of its own vectors, compares with the whole block,
and takes the smallest number of candidates at which ``recall`` of their
answers are found.  This is done alike at every size; no bucket or candidate
list is cut.

Equal vectors are indexed once with their k + 1 smallest ids, which is all
that an answer can hold, so a vector that many rows share costs one entry and
ties are exact.  Queries are sent to every block of vectors of their length,
and a block reads them in batches.

Defined results: null or zero vectors, those with null or non-finite
components and those without an id take no part; distances exist between
vectors of equal length, so a query is answered from those of its own length;
all arithmetic is in double precision.  An id that occurs several times is one
candidate, as near as its nearest vector, and one query, which never returns
its own id; equal distances go to the smaller id; fewer candidates than k give
all of them; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import materialise

BITS = 32


class Forest:
    """Sorted hash strings of the vectors of one block."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.vectors, self.trees = vectors, trees
        pairs = rng.integers(0, len(vectors), (2, trees * BITS))
        a, b = vectors[pairs[0]], vectors[pairs[1]]
        flat = (a == b).all(axis=1)  # a vector drawn twice gives no plane
        a[flat] = a[flat] + rng.standard_normal((int(flat.sum()), vectors.shape[1])) * (np.abs(vectors).max() + 1e-300)
        half_a, half_b = a / 2, b / 2  # halves, so that the largest doubles do not overflow
        self.planes = half_a - half_b
        self.planes /= np.abs(self.planes).max(axis=1, keepdims=True) + 1e-300
        self.offsets = np.einsum("ij,ij->i", self.planes, half_a + half_b)
        strings = self.strings_of(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def strings_of(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """(trees, n) hash strings, the first plane as the highest bit."""
        out = np.empty((self.trees, len(x)), np.uint32)
        for at in range(0, len(x), block):
            sides = (x[at : at + block] @ self.planes.T) > self.offsets
            packed = np.packbits(sides.reshape(-1, self.trees, BITS), axis=2)
            out[:, at : at + block] = packed.view(">u4")[:, :, 0].T
        return out

    def runs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits left out, tree, query): where the runs of equal prefix begin and end."""
        keys = self.strings_of(queries)
        low = np.empty((BITS + 1, *keys.shape), np.int32)
        high = np.empty_like(low)
        for cut in range(BITS + 1):
            mask = np.uint32((1 << cut) - 1)
            for t in range(self.trees):
                low[cut, t] = np.searchsorted(self.strings[t], keys[t] & ~mask, "left")
                high[cut, t] = np.searchsorted(self.strings[t], keys[t] | mask, "right")
        return low, high

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the positions of its candidates."""
        n = len(self.vectors)
        if enough >= n:
            for _ in queries:
                yield np.arange(n)
            return
        low, high = self.runs(queries)
        sizes = (high.astype(np.int64) - low).sum(axis=1)
        for q in range(len(queries)):
            # runs of a prefix less long hold those of a longer one, and all below this cut have too few together
            seen, cut = np.zeros(n, bool), int(np.searchsorted(sizes[:, q], enough))
            for t in range(self.trees):
                if cut:
                    seen[self.order[t, low[cut - 1, t, q] : high[cut - 1, t, q]]] = True
            while cut <= BITS:
                for t in range(self.trees):
                    seen[self.order[t, low[cut, t, q] : high[cut, t, q]]] = True
                    if np.count_nonzero(seen) >= enough:
                        cut = BITS
                        break
                cut += 1
            yield np.flatnonzero(seen)

    def steps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector the step of a query's ascent, over bits and trees, that takes it in."""
        out = np.full(len(self.vectors), (BITS + 1) * self.trees, np.int32)
        for t in range(self.trees):
            own = np.empty(len(out), np.int32)
            for cut in range(BITS, -1, -1):
                own[self.order[t, low[cut, t] : high[cut, t]]] = cut
            np.minimum(out, own * self.trees + t, out=out)
        return out

    def enough(self, k: int, probes: int, recall: float, seed: int) -> int:
        """The smallest number of candidates that meets ``recall`` for vectors of the block itself."""
        n = len(self.vectors)
        asked = np.random.default_rng(seed + 1).permutation(n)[:probes].tolist()
        low, high = self.runs(self.vectors[asked])
        needed = []  # for each answer, how many candidates the ascent must find to have it
        for q, i in enumerate(asked):
            d, steps = distances(self.vectors, self.vectors[i]), self.steps(low[:, :, q], high[:, :, q])
            d[i] = np.inf
            true = np.argsort(d, kind="stable")[: min(k, n - 1)]
            needed += (np.searchsorted(np.sort(steps), steps[true], "left") + 1).tolist()
        needed.sort()
        at = -(-int(recall * 1000) * len(needed) // 1000)
        return max(k + 1, needed[at - 1] if needed else 0)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; scaled where squares would overflow or vanish."""
    d = x - q
    with np.errstate(over="ignore", under="ignore"):
        s = np.einsum("ij,ij->i", d, d)
    out = np.sqrt(s)
    odd = ~np.isfinite(s) | ((s < 1e-290) & (d != 0).any(axis=1))
    if odd.any():
        d = d[odd]
        top = np.abs(d).max(axis=1)
        out[odd] = top * np.sqrt(((d / top[:, None]) ** 2).sum(axis=1))
    return out


def best(forest: Forest, ids: list[list[int]], query_ids: list[int], queries: np.ndarray, k: int, enough: int) -> list[tuple]:
    """(query_id, vec_id, score): the k best of one block for each query."""
    out = []
    for own, q, found in zip(query_ids, queries, forest.candidates(queries, enough), strict=True):
        d, most = distances(forest.vectors[found], q), k + 1  # one more than k: the query itself may be among them
        while True:
            near = np.arange(len(d)) if len(d) <= most else np.flatnonzero(d <= np.partition(d, most - 1)[most - 1])
            rows: dict[int, float] = {}
            for s, i in sorted((s, i) for p, s in zip(found[near].tolist(), d[near].tolist(), strict=True) for i in ids[p]):
                if i != own:
                    rows.setdefault(i, s)
            if len(rows) >= k or len(near) == len(forest.vectors):
                break
            if len(near) == len(d):  # candidates that share their ids: the whole block is asked
                found = np.arange(len(forest.vectors))
                d = distances(forest.vectors, q)
            most *= 2
        out += [(own, i, s) for i, s in list(rows.items())[:k]]
    return out


_OUT = "query_id long, vec_id long, score double"


def _searcher(k: int, trees: int, probes: int, recall: float, seed: int):
    """Reads rows of (dim, block, query, id, ids, v), a block's vectors before its queries."""

    def run(batches):
        at, held_v, held_ids, forest, enough = None, [], [], None, 0
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            if not len(keys):
                continue
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                dim, block, is_query = keys[lo].tolist()
                v = b.column(5).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, dim)
                if at != (dim, block):
                    at, held_v, held_ids, forest = (dim, block), [], [], None
                if not is_query:
                    held_v.append(v)
                    held_ids += b.column(4).slice(lo, hi - lo).to_pylist()
                    continue
                if not held_v:  # no vector fell into this block
                    continue
                if forest is None:
                    forest = Forest(np.concatenate(held_v), trees, seed)
                    held_v = [forest.vectors]
                    enough = forest.enough(k, probes, recall, seed)
                query_ids = b.column(3).slice(lo, hi - lo).to_pylist()
                for q in range(0, hi - lo, 256):
                    rows = best(forest, held_ids, query_ids[q : q + 256], v[q : q + 256], k, enough)
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                            names=["query_id", "vec_id", "score"],
                        )

    return run


def nearest(
    embeddings: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 32_768,
    trees: int = 64,
    probes: int = 64,
    recall: float = 0.95,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id ``every`` divides."""
    usable = (
        embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
        .where(F.exists("v", lambda e: e != 0))
        .distinct()
    )
    same = Window.partitionBy("v").orderBy("id")
    lowest = usable.select("v", "id", F.row_number().over(same).alias("r")).where(F.col("r") <= k + 1)
    index = materialise(lowest.groupBy("v").agg(F.collect_list("id").alias("ids")), "neighbours-index")
    asked = usable.where(F.pmod("id", F.lit(every)) == 0)
    dim = F.size("v").alias("dim")
    blocks = index.groupBy(dim).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    deal = lambda df: df.withColumn("dim", F.size("v")).join(blocks, "dim")
    none = F.lit(None)
    vectors = deal(index).select(
        "dim", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"), F.lit(0).alias("query"), none.cast("long").alias("id"), "ids", "v"
    )
    queries = deal(asked).select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "id", none.cast("array<long>").alias("ids"), "v"
    )
    both = vectors.unionByName(queries)
    n = max(1, blocks.agg(F.sum("blocks")).first()[0] or 0)
    dealt = both.repartition(n, "dim", "block").sortWithinPartitions("dim", "block", "query")
    found = dealt.mapInArrow(_searcher(k, trees, probes, recall, seed), _OUT)
    nearest_of = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return nearest_of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
