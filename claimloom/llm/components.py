"""Connected components of an edge table by repeated small joins; nothing of them reaches the driver but a count."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import frames


def checkpoint_folder(df: DataFrame) -> None:
    """Use the shared folder the cluster names. Where it names none, a session in one process gets a folder of its own; a cluster is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimloom-"))


def _state(links: DataFrame) -> tuple:
    """What tells two tables of distinct links apart: their number and a sum of their hashes."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of all ids in ``edges`` (a, b): component is the smallest id that edges reach.

    Each round links every id to the smallest neighbour seen from either side (large star, then small star), until
    every id has one link only. Each round's table is checkpointed.
    """
    checkpoint_folder(edges)
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = _state(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        links, now = small, _state(small)
        del both, least, large, small
        frames.rest(links.sparkSession)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
