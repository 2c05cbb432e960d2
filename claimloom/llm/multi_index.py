"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Centroids are fitted on about so many vectors at most (by a hash of the id); every vector is indexed.
FIT_VECTORS = 20_000
#: Vectors that a cell has on average, the most centroids of a half, and the vectors of a block that one task holds.
CELL_VECTORS, MOST_CENTROIDS, BLOCK = 100, 64, 4096
#: A search goes on from cell to cell until it has seen this share of all vectors, and this many at least.
SHARE, LEAST_SEEN = 0.75, 2000
#: Queries whose nearest so far a task holds before it hands them on.
QUERIES_HELD = 20_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = squared(x, c).argmin(1)
        for j in range(k):
            if (mine := at == j).any():
                c[j] = x[mine].mean(0)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


@dataclass
class MultiIndex:
    """Centroids of both halves, and the number of vectors of each pair of centroids (a cell)."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return squared(x[:, :h], self.first).argmin(1) * len(self.second) + squared(x[:, h:], self.second).argmin(1)

    def blocks(self, cell: int) -> int:
        return max(1, -(-int(self.sizes[cell]) // BLOCK))

    def walk(self, q: np.ndarray, share: float, least: int):
        """Cells that hold vectors, by summed distance of their two centroids, until enough vectors have been seen."""
        h = self.first.shape[1]
        d, e = squared(q[None, :h], self.first)[0], squared(q[None, h:], self.second)[0]
        by_d, by_e = np.argsort(d, kind="stable"), np.argsort(e, kind="stable")
        want, seen = max(least, share * self.sizes.sum()), 0
        heap, pushed = [(d[by_d[0]] + e[by_e[0]], 0, 0)], {(0, 0)}
        while heap and seen < want:
            _, i, j = heapq.heappop(heap)
            cell = int(by_d[i]) * len(e) + int(by_e[j])
            if self.sizes[cell]:
                seen += int(self.sizes[cell])
                yield cell
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(d) and b < len(e) and (a, b) not in pushed:
                    pushed.add((a, b))
                    heapq.heappush(heap, (d[by_d[a]] + e[by_e[b]], a, b))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, np.float64)], pa.binary())


def build(rows: DataFrame, dimension: int, n: int) -> tuple[MultiIndex, DataFrame]:
    """The index of rows (id, v array<double>), and (id, v binary, cell) of each."""
    k = int(min(MOST_CENTROIDS, max(1, round((n / CELL_VECTORS) ** 0.5))))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT_VECTORS / n)) + 1)
    x = _matrix(some.orderBy("id").select("v").toArrow().combine_chunks()["v"].combine_chunks())
    k, h = min(k, len(x)), dimension // 2
    index = MultiIndex(kmeans(x[:, :h], k), kmeans(x[:, h:], k), np.zeros(k * k, np.int64))
    held = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), _binary(v), pa.array(held.value.cells(v), pa.int32())], names=["id", "v", "cell"])

    placed = rows.mapInArrow(assign, "id long, v binary, cell int")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MOST_CENTROIDS ** 2 rows
        index.sizes[r["cell"]] = r["n"]
    return index, placed


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, least: int = LEAST_SEEN) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row that ``is_query`` holds for.

    Score is the Euclidean distance in double precision; the nearest comes first, ties by smaller id; a query's own id
    is no candidate. Rows with a null id, and vectors that are null, zero or hold null or non-finite components take no
    part, nor do vectors of another length than most have. Queries without candidates have no rows. Repeated ids are
    candidates as often as they occur. Other columns are left out.

    Cells are dealt out in blocks of about ``BLOCK`` vectors, so one frequent vector is no single task's. A block's
    vectors are held as a matrix while the queries that reach its cell stream by.
    """
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = sorted(((r["n"], -r["s"]) for r in rows.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    spark = df.sparkSession
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dimension = lengths[0][0], -lengths[0][1]
    rows = rows.where(F.size("v") == dimension)
    index, placed = build(rows.select("id", "v"), dimension, n)
    sent = spark.sparkContext.broadcast(index)
    blocks = F.array(*[F.lit(index.blocks(c)) for c in range(len(index.sizes))])
    stored = placed.select("cell", F.pmod(F.xxhash64("id", "v"), F.get(blocks, F.col("cell"))).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")

    def reach(batches):
        index = sent.value
        for b in batches:
            out = [[], [], [], []]
            for key, q in zip(b.column(0).to_pylist(), _matrix(b.column(1))):
                data = np.ascontiguousarray(q, np.float64).tobytes()
                for cell in index.walk(q, share, least):
                    for block in range(index.blocks(cell)):
                        for held, x in zip(out, (cell, block, key, data)):
                            held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array([1] * len(out[0]), pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["cell", "block", "kind", "id", "v"])

    asked = rows.where("q").select("id", "v").mapInArrow(reach, "cell int, block int, kind int, id long, v binary")
    both = stored.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "id")

    def meet(batches):
        at, ids, x, held = None, None, None, []
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            cell, block, kind, key = (b.column(j).to_numpy() for j in range(4))
            v = b.column(4)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
                m = np.frombuffer(b"".join(v.slice(start, end - start).to_pylist()), np.float64).reshape(end - start, -1)
                here = (cell[start], block[start])
                if kind[start] == 0:
                    held = [*held, (key[start:end], m)] if at == here else [(key[start:end], m)]
                    at, x = here, None
                elif at == here:
                    if x is None:
                        ids, x = np.concatenate([a for a, _ in held]), np.concatenate([a for _, a in held])
                    for s in range(0, len(m), 256):
                        _nearest(key[start + s : min(end, start + s + 256)], m[s : s + 256], ids, x, k, best)
            if len(best) > QUERIES_HELD:
                yield _handed(best)
                best.clear()
        if best:
            yield _handed(best)

    near = both.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _handed(best: dict) -> pa.RecordBatch:
    q = np.repeat(np.fromiter(best, np.int64, len(best)), [len(a) for a, _ in best.values()])
    columns = [pa.array(q), *(pa.array(np.concatenate([x[j] for x in best.values()])) for j in range(2))]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def _nearest(queries: np.ndarray, m: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, best: dict) -> None:
    """Puts each query's nearest of a block to its best: a matrix product finds those that may be, differences give the distance."""
    rough = squared(m, x)
    rough[queries[:, None] == ids[None]] = np.inf
    j = min(k, rough.shape[1]) - 1
    for q, row, d, most in zip(queries.tolist(), m, rough, np.partition(rough, j, axis=1)[:, j]):
        near = np.flatnonzero(np.isfinite(d) & (d <= most + 1e-9 * (1 + most)))
        key, far = ids[near], np.sqrt(((x[near] - row) ** 2).sum(1))
        if q in best:
            key, far = np.concatenate([best[q][0], key]), np.concatenate([best[q][1], far])
        first = np.lexsort((key, far))[:k]
        best[q] = key[first], far[first]


def exact(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same without approximation: every cell is visited. For measuring recall."""
    return search(df, is_query, k, id_col, vector_col, share=1.0)
