"""Importance resampling towards a target text collection: hashed n-gram postings, a gain for each bucket, a seeded draw."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.components import checkpoint_folder
from claimloom.llm.frames import give_back, map_slices

BUCKETS = 10_000
#: Buckets are dealt to so many parts; a posting row holds one part of one block of documents.
PARTS = 32
#: A block is closed at so many documents or features.
BLOCK_DOCS, BLOCK_FEATURES = 4096, 1 << 18
#: Posting rows of one part that meet in one group.
GROUP_ROWS = 64
#: Bytes of a text that are words at a time.
PIECE = 1 << 18
#: A-Z lower-cased; what is neither an ASCII letter or digit nor part of another character parts words.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in lists, none of much more than ``PIECE`` bytes unless one word is."""
    low, start = (text or b"").translate(LETTERS), 0
    while start < len(low):
        end = low.find(b" ", start + PIECE) if start + PIECE < len(low) else -1
        end = len(low) if end < 0 else end
        yield low[start:end].split()
        start = end


def features(text: bytes | None, most: int = 2) -> Iterator[list[int]]:
    """crc32 of all runs of 1 to ``most`` words joined by a blank, in lists by piece and length; a run may span pieces."""
    tail: list[bytes] = []
    for words in pieces(text):
        held = tail + words
        spaced = [b" " + w for w in held]
        sums = list(map(crc32, held))  # of the run of k words from each place
        yield sums[len(tail) :]
        for k in range(2, most + 1):
            sums = list(map(crc32, spaced[k - 1 :], sums))
            yield sums[max(0, len(tail) - k + 1) :]
        tail = held[1 - most :] if most > 1 else []


def _pack(buckets: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    width = np.min_scalar_type(int(counts.max()))
    raw = np.array([len(buckets), width.itemsize], "<i4").tobytes() + buckets.astype("<u2").tobytes() + docs.astype("<u2").tobytes() + counts.astype(width).tobytes()
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data[:8], "<i8")[0]), codec="zstd", asbytes=True)
    n, width = np.frombuffer(raw[:8], "<i4").tolist()
    return np.frombuffer(raw, "<u2", n, 8), np.frombuffer(raw, "<u2", n, 8 + 2 * n), np.frombuffer(raw, f"u{width}", n, 8 + 4 * n)


class _Blocks:
    """Rows (kind, corpus, part, block, ids, n_features, n_words, data) of one task: a ``block`` row for the documents of
    each block, a ``posting`` row for each part of its buckets, and a ``total`` row of all counts by bucket at the end."""

    def __init__(self, corpus: int):
        self.corpus, self.block, self.totals = corpus, TaskContext.get().partitionId() << 32, np.zeros(BUCKETS, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.ids, self.sizes, self.words, self.held, self.n = [], [], [], [], 0

    def __call__(self, columns: list) -> Iterator[tuple]:
        for key, text in zip(*columns):
            n = words = 0
            for k, sums in enumerate(features(text)):
                words += len(sums) if k % 2 == 0 else 0
                n += len(sums)
                self.held.append((len(self.ids), np.array(sums, np.uint32) % np.uint32(BUCKETS)))
            self.ids.append(key)
            self.sizes.append(n)
            self.words.append(words)
            self.n += n
            if self.n >= BLOCK_FEATURES or len(self.ids) >= BLOCK_DOCS:
                yield from self._close()

    def _close(self) -> Iterator[tuple]:
        yield "block", self.corpus, None, self.block, self.ids, self.sizes, self.words, None
        key = np.concatenate([b.astype(np.int64) * BLOCK_DOCS + d for d, b in self.held]) if self.held else np.zeros(0, np.int64)
        key, counts = np.unique(key, return_counts=True)
        bucket, doc = key // BLOCK_DOCS, key % BLOCK_DOCS
        np.add.at(self.totals, bucket, counts)
        for part in range(PARTS):
            at = np.flatnonzero(bucket % PARTS == part)
            if len(at):
                yield "posting", self.corpus, part, self.block, None, None, None, _pack(bucket[at] // PARTS, doc[at], counts[at])
        self.block += 1
        self._clear()

    def finish(self) -> Iterator[tuple]:
        if self.ids:
            yield from self._close()
        yield "total", self.corpus, None, None, None, self.totals.tolist(), None, None


def postings(df: DataFrame, corpus: int, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"kind string, corpus int, part int, block long, ids array<{kind}>, n_features array<bigint>, n_words array<bigint>, data binary"
    return map_slices(df.select(F.col(id_col), F.col(text_col).cast("binary")), lambda: _Blocks(corpus), schema)


def _gains(here: pa.Table) -> np.ndarray:
    """Of each bucket of a part, from both corpora's counts of it."""
    row = here.slice(0, 1).to_pylist()[0]
    return np.array([floor(1000 * log((t + 1) * (row["all_s"] + BUCKETS) / ((s + 1) * (row["all_t"] + BUCKETS)))) for s, t in zip(row["s"], row["t"])], np.float64)


def _contributions(left: pa.Table, right: pa.Table) -> pa.Table:
    """A row (block, gains) for each posting row: what its buckets add to each document of the block."""
    blocks, out = [], []
    if left.num_rows:
        gain = _gains(right)
        for block, data in zip(left["block"].to_pylist(), left["data"]):
            bucket, doc, count = _unpack(data.as_py())
            blocks.append(block)
            out.append(np.bincount(doc, weights=gain[bucket] * count).astype(np.int64))  # whole numbers below 2**53: exact
    table = pa.table({"block": pa.array(blocks, pa.int64()), "gains": pa.array(out, pa.list_(pa.int64()))})
    give_back()
    return table


def _reduced(left: pa.Table, right: pa.Table) -> pa.Table:
    """A row for each document of a block, its contributions summed over parts."""
    ids, n, words = (left[c].combine_chunks().flatten() for c in ("ids", "n_features", "n_words"))
    total = np.zeros(len(ids), np.int64)
    for gains in right["gains"]:
        g = gains.values.to_numpy()
        total[: len(g)] += g
    n_ = n.to_numpy()
    return pa.table({"id": ids, "n_features": n, "n_words": words, "weight": pa.array(np.where(n_ > 0, total // np.maximum(n_, 1), 0))})


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight) of each row of ``docs``: the floored mean gain of its features' buckets.

    Postings (bucket, document, count) of both corpora are packed by block of documents and part of buckets, written to
    the shared folder once, and shuffled by part; a part's rows are dealt to as many groups as it has GROUP_ROWS posting
    rows, so no bucket, however frequent, fills a task. Each group meets its part's counts of both corpora (10,000
    numbers in all, summed by task before), computes the gains of its buckets there and emits what they add to each
    document of a block; a block's rows, one a part, are summed to documents. Nothing but two totals and the number of
    posting rows reaches the driver.
    """
    checkpoint_folder(docs)
    spark = docs.sparkSession
    at = f"{spark.sparkContext.getCheckpointDir()}/postings-{uuid.uuid4().hex}"
    plain = postings(target, 1, target_id, target_text).withColumn("ids", F.lit(None).cast(f"array<{docs.schema[id_col].dataType.simpleString()}>"))
    postings(docs, 0, id_col, text_col).unionByName(plain).write.parquet(at)
    held = spark.read.parquet(at)
    counts = held.where("kind = 'total'").select("corpus", F.posexplode("n_features").alias("bucket", "n")).groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("corpus") == c, F.col("n"))), F.lit(0)).alias(a) for c, a in ((0, "s"), (1, "t"))])
    rows, all_s, all_t = held.where("kind = 'posting' AND corpus = 0").count(), *counts.agg(F.sum("s"), F.sum("t")).first()
    groups = max(1, -(-rows // (PARTS * GROUP_ROWS)))
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.floor(F.col("bucket") / PARTS).alias("b"), "s", "t"))), lambda x: F.struct(x["s"].alias("s"), x["t"].alias("t")))
    parts = counts.groupBy((F.col("bucket") % PARTS).alias("part")).agg(each.alias("x")).select("part", F.col("x.s").alias("s"), F.col("x.t").alias("t"), F.lit(all_s or 0).alias("all_s"), F.lit(all_t or 0).alias("all_t"))
    parts = parts.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    mine = held.where("kind = 'posting' AND corpus = 0").select("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), "block", "data")
    added = mine.groupBy("part", "group").cogroup(parts.groupBy("part", "group")).applyInArrow(_contributions, "block long, gains array<bigint>")
    blocks = held.where("kind = 'block' AND corpus = 0").select("block", "ids", "n_features", "n_words")
    kind = docs.schema[id_col].dataType.simpleString()
    return blocks.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(_reduced, f"id {kind}, n_features long, n_words long, weight long")


def score(weight: Column, key: Column, seed: int = 7) -> Column:
    """weight + floor(-1000 ln(-ln(u))): u is made of the first 8 hex digits of SHA-256 of ``seed:key``; a null key is empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", share: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """id, n_features, weight, score, rank of each row: ``share`` in a hundred of the rows of ``least_words`` words or more are drawn.

    A weight is the mean gain of a document's features, floored: gain of a bucket is floor(1000 ln of how much likelier
    it is in the target), with one added to each bucket. Null and empty texts have no features, weight 0, and are not
    drawn. Ranks count from 1 by falling score, then rising id (null last), then weight and features; rows that are
    not drawn have none. Rows of one id share their noise and each have their rank. Without target texts, and without
    documents, gains come from what there is. Other columns play no part.

    Scores are whole numbers in a range that the logarithms bound (under 100,000 values at any size), so the number of
    better rows is a running sum over the scores' counts, broadcast; places within one score are a window of one score.
    """
    key = F.col("id")
    rows = weigh(docs, target, id_col, text_col, target_id, target_text)
    rows = rows.select("id", "n_features", "weight", score(F.col("weight"), key, seed).alias("score"), (F.col("n_words") >= least_words).alias("open")).checkpoint()
    drawn = rows.where("open").count() * share // 100
    better = rows.where("open").groupBy("score").agg(F.count("*").alias("n"))
    better = better.select(F.col("score").alias("__score"), (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("__better")).where(F.col("__better") < drawn)
    rows = rows.join(F.broadcast(better), F.col("open") & (F.col("score") == F.col("__score")), "left")
    spread = F.when(F.col("__better").isNull(), F.xxhash64("id", "score"))  # rows that cannot be drawn are not sorted in one place
    place = F.row_number().over(Window.partitionBy("__better", spread).orderBy(key.asc_nulls_last(), F.desc("weight"), "n_features"))
    rank = F.col("__better") + place
    return rows.select(key.alias(id_col), "n_features", "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank"))
