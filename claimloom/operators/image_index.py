"""A stored index of pictures' vectors: written by cell, grown in batches, read by version, searched exactly in the cells that can hold a match."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.operators import media

#: Vectors that cells are fitted on, entries of a cell that meet at a time, and queries.
SAMPLE, BLOCK, ASKED = 8192, 20_000, 4096


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [n for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _fitted(vectors: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means; the starts are spread over the sample."""
    x = _unit(vectors)
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))]))
    return c


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: it is there, all finite, and not zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["v"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()], float)  # one row a cell


def build(entries: DataFrame, path: str, cells: int = 64, vector: str = "embedding", key: str = "id") -> int:
    """Makes the index of ``entries`` (key, vector, and any columns to keep); its first version.

    Cells are fitted on at most ``SAMPLE`` vectors, the smallest by hash of their key. Entries without a direction, and
    those not as wide as most of the sample, are left out.
    """
    spark = entries.sparkSession
    sample = entries.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(SAMPLE).collect()
    widths = [len(r["v"]) for r in sample]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    c = _fitted(np.array([r["v"] for r in sample if len(r["v"]) == width], float), cells) if sample else np.zeros((0, 0))
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(c)], "cell int, v array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")
    return append(entries, path, vector, key)


def append(entries: DataFrame, path: str, vector: str = "embedding", key: str = "id") -> int:
    """Adds a batch; the new version's number.

    The batch is written to files of its own, by cell, and then a manifest that lists it with all before: readers see
    the new version when its manifest is complete and none of it before. Of two writers of one version the second
    fails, and its files are in no manifest.
    """
    spark = entries.sparkSession
    n = max(_versions(spark, path), default=0) + 1
    c = _centroids(spark, path)
    width = c.shape[1] if len(c) else 0
    rows = entries.where(usable(F.col(vector)) & (F.size(vector) == width))
    target = rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))

    def assigned(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(np.array(b.column(b.schema.get_field_index(vector)).to_pylist(), float))
            near = x @ c.T
            cell = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    at = f"{path}/entries/batch={n}"
    rows.mapInArrow(assigned, target.schema).repartition("cell").sortWithinPartitions("cell", key).write.mode("errorifexists").partitionBy("cell").parquet(at)
    written = spark.read.option("basePath", f"{path}/entries").schema(target.withColumn("batch", F.lit(0)).schema).parquet(at)  # a batch may be empty
    new = written.groupBy("batch", "cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    if n > 1:
        new = spark.read.parquet(f"{path}/manifest/v{n - 1}").unionByName(new)
    new.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/v{n}")
    return n


def _read(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """Stored entries of some batches; folders give batch and cell."""
    return spark.read.option("basePath", f"{path}/entries").parquet(*[f"{path}/entries/batch={b}" for b in batches])


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """batch, cell, rows, radius of a version, the latest if none is named."""
    known = _versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version or ''} of an index at {path}")
    return spark.read.parquet(f"{path}/manifest/v{version or known[-1]}")


def probed(queries: DataFrame, path: str, floor: float, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(asked, entries): each query (id, v) with the cells that can hold an entry of at least ``floor`` cosine, and the stored entries of any such cell.

    An entry lies within its cell's radius of the centroid; a query farther away than that radius and the floor's angle
    together has no match there. The scan reads the folders of these cells only.
    """
    spark = queries.sparkSession
    cells = manifest(spark, path, version).groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("rows").alias("rows"), F.collect_set("batch").alias("batches")).collect()  # one row a cell
    c, batches = _centroids(spark, path), sorted({b for r in cells for b in r["batches"]})
    reach = np.full(len(c), -np.inf)
    for r in cells:
        reach[r["cell"]] = r["radius"] + np.arccos(np.clip(floor, -1, 1)) + 1e-9
    blocks = {r["cell"]: -(-r["rows"] // BLOCK) for r in cells}
    width = c.shape[1] if len(c) else 0
    asked = queries.where(usable(F.col("v")) & (F.size("v") == width)).select("id", F.col("v").cast("array<double>").alias("v"))
    schema = asked.select("*", F.lit(0).alias("cell"), F.lit(0).alias("block")).schema

    def cells_of(parts):
        import pyarrow as pa

        for b in parts:
            if not b.num_rows:
                continue
            x = _unit(np.array(b.column(1).to_pylist(), float))
            i, j = np.nonzero(np.arccos(np.clip(x @ c.T, -1, 1)) <= reach)
            out = [(a, k, s) for a, k in zip(i.tolist(), j.tolist()) for s in range(blocks[k])]
            at = pa.array([a for a, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([k for _, k, _ in out], pa.int32()), pa.array([s for _, _, s in out], pa.int32())], names=["id", "v", "cell", "block"])

    asked = asked.mapInArrow(cells_of, schema).persist()
    wanted = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # a cell's number each
    return asked, _read(spark, path, batches).where(F.col("cell").isin(wanted) if wanted else F.lit(False))


def search(queries: DataFrame, path: str, floor: float = 0.95, k: int = 3, version: int | None = None, vector: str = "embedding", key: str = "id") -> DataFrame:
    """(image_id, entry_id, similarity, rank): each query's (id, v) ``k`` most similar entries of at least ``floor``, none missed.

    Equal similarities go by entry; a query is not matched with the entry of its own id. Queries without a direction, or
    of another width than the index, find nothing, and nothing is found in an empty index. Queries and entries of a cell meet as matrix products in blocks, and
    only the best ``k`` of a block leave it.
    """
    if manifest(queries.sparkSession, path, version).isEmpty():
        return queries.limit(0).select(F.col("id").alias("image_id"), F.lit("").alias("entry_id"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    asked, entries = probed(queries, path, floor, version)
    rows = manifest(queries.sparkSession, path, version).groupBy("cell").agg(F.sum("rows").alias("n")).collect()  # one row a cell
    blocks = F.lit(1)
    for r in rows:
        if r["n"] > BLOCK:
            blocks = F.when(F.col("cell") == r["cell"], -(-r["n"] // BLOCK)).otherwise(blocks)
    held = entries.select(F.col(key).alias("entry_id"), F.col(vector).cast("array<double>").alias("w"), "cell", F.pmod(F.xxhash64(key), blocks.cast("long")).cast("int").alias("block"))
    parts = max(1, -(-asked.count() // ASKED))
    left = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    right = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = f"image_id {queries.schema['id'].dataType.simpleString()}, entry_id {entries.schema[key].dataType.simpleString()}, similarity double"

    def meet(a, b):
        import pyarrow as pa

        out = ([], [], [])
        if len(a) and len(b):
            x, y = _unit(np.array(a["v"].to_pylist(), float)), _unit(np.array(b["w"].to_pylist(), float))
            names, own = b["entry_id"].to_pylist(), a["id"].to_pylist()
            sim = x @ y.T
            for i in range(len(x)):
                near = [(-sim[i, j], names[j]) for j in np.nonzero(sim[i] >= floor)[0] if names[j] != own[i]]
                for s, e in sorted(near)[:k]:
                    out[0].append(own[i])
                    out[1].append(e)
                    out[2].append(-float(s))
        return pa.table({"image_id": pa.array(out[0], a["id"].type), "entry_id": pa.array(out[1], b["entry_id"].type), "similarity": pa.array(out[2], pa.float64())})

    keys = ["cell", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, kinds)
    order = Window.partitionBy("image_id").orderBy(F.desc("similarity"), "entry_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def passed(images: DataFrame, claims: DataFrame, path: str, entries: DataFrame, today: dt.date, floor: float = 0.95, gap_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(candidates, flags) of pictures (packet_id, image_id, image_index, v, day) against the index.

    Every match is evidence for the claims its picture belongs to (``media.claims_for_images``), with the entry's
    context. A picture is flagged once, by its earliest match: ``date_mismatch`` if that lies ``gap_days`` or more before
    the picture's day (``today`` where it has none). entries: id, first_seen (a date), context.
    """
    found = search(images.select(F.col("image_id").alias("id"), "v"), path, floor).join(entries.select(F.col("id").alias("entry_id"), "first_seen", "context"), "entry_id")
    first = media.oldest_first(found.drop("rank"), "image_id", "first_seen", "entry_id").where("rank = 1")
    gap = F.date_diff(F.coalesce("day", F.lit(today)), F.col("first_seen"))
    flags = images.select("packet_id", "image_id", "day").join(first.select("image_id", "entry_id", "first_seen"), "image_id", "left").withColumn("date_mismatch", F.coalesce(gap >= gap_days, F.lit(False)))
    of = media.claims_for_images(images, claims)
    return found.join(of, "image_id").select("claim_id", "image_id", "entry_id", F.lit("image").alias("source_type"), F.lit(0.9).alias("source_weight"), F.col("similarity").alias("score"), "first_seen", "context"), flags
