"""Images: key frames, index matches, captions and the candidates they give."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import vectors


def oldest_first(matches: DataFrame, key: str, day: str, by: str) -> DataFrame:
    """Each image's matches by rank: the oldest first, those without a day last, ties by ``by``."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(day), by)))


def keyframes(frames: DataFrame, key: str = "packet_id", order: str = "frame_time", vector: str = "embedding", similar: float = 0.95, most: int = 8) -> DataFrame:
    """Frames kept, greedily in order: one goes if its cosine with a kept one is above ``similar``; frames without a
    vector stay; a message keeps ``most``. One message's frames are one group, and few."""
    names = [c for c in frames.columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        kept, units = [], []
        for k, row in pdf.sort_values(order, kind="stable").iterrows():
            if len(kept) == most:
                break
            v = row[vector]
            if v is None:
                kept.append(k)
                continue
            v = np.asarray(v, float)
            n = np.linalg.norm(v)
            v = v / n if n else v
            if not any(float(v @ u) > similar for u in units):
                kept.append(k)
                units.append(v)
        return pdf.loc[kept, names]

    return frames.groupBy(key).applyInPandas(run, kinds)


def usable_index(index: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is as wide as the widest."""
    widest = index.agg(F.max(F.size(vector)).alias("__w"))
    return index.crossJoin(F.broadcast(widest)).where(F.size(vector) == F.col("__w")).drop("__w")  # one row


def index_matches(images: DataFrame, index: DataFrame, floor: float = 0.95, k: int = 3) -> DataFrame:
    return vectors.similar_pairs(images, index, floor, k)


def claims_for_images(images: DataFrame, claims: DataFrame) -> DataFrame:
    """image_id, claim_id: claims read out of a picture, else all check-worthy claims of its message."""
    own = images.join(claims.where("image_index IS NOT NULL"), ["packet_id", "image_index"]).select("image_id", "claim_id")
    rest = images.join(own.select("image_id"), "image_id", "left_anti").join(claims.where("check_worthy").select("packet_id", "claim_id"), "packet_id")
    return own.unionByName(rest.select("image_id", "claim_id")).distinct()


def consistency(similarity: Column, second: Column | None = None, floor: float = 0.2) -> Column:
    """struct<mismatch, stance, score>: a caption below ``floor`` refutes unless a second opinion reaches it; unknown is no mismatch."""
    value = similarity if second is None else F.when(similarity < floor, F.greatest(similarity, second)).otherwise(similarity)
    off = F.coalesce(value < floor, F.lit(False))
    return F.struct(off.alias("mismatch"), F.when(off, "refutes").alias("stance"), F.when(off, F.lit(1.0) - value).alias("score"))


def candidates(matches: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Evidence of index matches (weight 0.9) and caption mismatches (0.6); these weights are not replaced by a tier's."""
    a = matches.select("claim_id", "image_id", F.lit("image").alias("source_type"), F.lit(0.9).alias("source_weight"), "score")
    b = mismatches.select("claim_id", "image_id", F.lit("image").alias("source_type"), F.lit(0.6).alias("source_weight"), "score")
    return a.unionByName(b)


def report(images: DataFrame, kept: DataFrame, matches: DataFrame, mismatches: DataFrame) -> DataFrame:
    """One row of counts; date mismatches count pictures, not claims."""
    one = lambda df, c, name: df.agg(c.alias(name))
    parts = [one(images, F.count("*"), "images"), one(kept, F.count("*"), "kept"), one(matches, F.count_distinct("image_id"), "matches"), one(mismatches, F.count_distinct("image_id"), "mismatches"), one(images.where("date_mismatch"), F.count_distinct("image_id"), "date_mismatches")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("dropped", F.col("images") - F.col("kept"))
