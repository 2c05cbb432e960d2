"""Vector and ratio functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.nullif(u, F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """The share of ``a`` that ``b`` has; 0 for an empty ``a``."""
    return F.coalesce(F.size(F.array_intersect(a, b)).cast("double") / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def rate(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


#: Sides of similarity joins up to so many rows are sent to all tasks; beyond that both sides meet in blocks.
SMALL_SIDE, BLOCKS = 20_000, 16


def similar_pairs(left: DataFrame, right: DataFrame, floor: float, k: int = 3) -> DataFrame:
    """(left_id, right_id, similarity): for each row of ``left`` (id, v) its ``k`` nearest rows of ``right`` at or above ``floor``.

    The search is exact, a query set against all rows. Rows of ``left`` meet all of ``right`` as a matrix product in
    tasks: ``right`` goes to all tasks if it is small, else it is dealt out in blocks and ``left`` to each of them. The
    product only proposes pairs; a pair's similarity is the sum of its products in order over the root of both squares,
    so that copies of a vector get the very same figure wherever they meet, and ties stay ties.
    """
    n = right.count()
    blocks = 1 if n <= SMALL_SIDE else -(-n // SMALL_SIDE)
    stored = right.select(F.col("id").alias("rid"), F.col("v").cast("array<double>").alias("rv"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    asked = left.select(F.col("id").alias("lid"), F.col("v").cast("array<double>").alias("lv")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = f"left_id {left.schema['id'].dataType.simpleString()}, right_id {right.schema['id'].dataType.simpleString()}, similarity double"

    def meet(a, b):
        import numpy as np
        import pyarrow as pa

        matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)


        def in_order(x, y):
            total = np.zeros(len(x))
            for k in range(x.shape[1]):
                total += x[:, k] * y[:, k]
            return total

        found = []
        if len(a) and len(b):
            p, q = matrix(a["lv"]), matrix(b["rv"])
            x, y, xx, yy = unit(p), unit(q), in_order(p, p), in_order(q, q)
            for s in range(0, len(a), 1024):
                near, far = np.nonzero(x[s : s + 1024] @ y.T >= floor - 1e-9)
                for t in range(0, len(near), 65_536):
                    i, j = near[t : t + 65_536] + s, far[t : t + 65_536]
                    squares = xx[i] * yy[j]
                    sim = np.where(squares == 0, 0.0, in_order(p[i], q[j]) / np.sqrt(np.where(squares == 0, 1.0, squares)))
                    there = sim >= floor
                    found.append((i[there], j[there], sim[there]))
        i, j, sim = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"left_id": a["lid"].take(pa.array(i, pa.int64())), "right_id": b["rid"].take(pa.array(j, pa.int64())), "similarity": sim})

    salt = F.pmod(F.xxhash64("lid"), F.lit(BLOCKS)).cast("int").alias("s")
    found = asked.select("*", salt).groupBy("b", "s").cogroup(stored.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).groupBy("b", "s"))
    pairs = found.applyInArrow(meet, kinds).where(F.col("left_id") != F.col("right_id"))
    order = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
