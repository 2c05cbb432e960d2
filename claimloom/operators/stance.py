"""Passages, ranking, model scores and stances of evidence toward claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text, vectors
from claimloom.operators import scoring
from claimloom.sources.folders import checkpointing


def gated(evidence: DataFrame) -> DataFrame:
    """``gate``: only rated items can be about another claim; the others pass."""
    return evidence.withColumn("gate", F.when(F.col("rating").isNotNull() & (F.col("rating") != "unknown"), F.coalesce("about", F.lit("unclear"))).otherwise("about"))


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of binary vectors of terms: the ranker where no embedder is given."""
    n = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(n, F.lit(0.0)), F.lit(0.0))


def ranked(evidence: DataFrame, claims: DataFrame, floor: float = 0.3, k: int = 3, read=text.content_terms, alike=term_cosine) -> DataFrame:
    """Passages at or above ``floor``, ``k`` a document, with each document's best score whether any passes or not.

    Items that passed the gate are cut into passages; the others get none and cost no model time. A text is cut and its
    passages are read once, however many claims it meets. ``alike`` compares what ``read`` makes of a claim and a passage.
    """
    rows = evidence.where("gate <> 'not_about'").select("claim_id", F.col("id").alias("evidence_id"), text.body(F.col("title"), F.col("snippet"), F.col("text")).alias("__body"))
    rows = rows.withColumn("__text", F.sha2("__body", 256))
    cut = rows.groupBy("__text").agg(F.first("__body").alias("__body")).select("__text", text.passages(F.col("__body")).alias("__p"))
    cut = cut.select("__text", "__p", F.transform("__p", read).alias("__read"))
    asked = claims.select("claim_id", read(F.col("text")).alias("__claim"))
    likeness = F.transform("__read", lambda p, i: F.struct((-F.round(F.greatest(alike(F.col("__claim"), p), F.lit(0.0)), 4)).alias("less"), i.alias("pos")))
    best = F.transform(F.slice(F.array_sort(likeness), 1, max(k, 1)), lambda x: F.struct(x["pos"].alias("pos"), F.get("__p", x["pos"]).alias("passage"), (F.lit(0.0) - x["less"]).alias("similarity")))
    rows = rows.select("claim_id", "evidence_id", "__text").join(asked, "claim_id").join(cut, "__text").select("claim_id", "evidence_id", F.inline(best))
    doc = Window.partitionBy("claim_id", "evidence_id")
    rows = rows.withColumn("best", F.max("similarity").over(doc)).withColumn("rank", F.row_number().over(doc.orderBy(F.desc("similarity"), "pos")))
    return rows.withColumn("relevant", (F.col("similarity") >= floor) & (F.col("rank") <= k)).where((F.col("rank") == 1) | F.col("relevant"))


def strongest(votes: DataFrame, keys: list[str], floor: float = 0.5, order: str | None = None, neutral: str | None = None) -> DataFrame:
    """The strongest side from ``floor`` among supports and refutes, else the surest neutral; of equal ones the first by
    ``order`` falling, then by position. ``neutral``: a column with every vote's neutral score, else only neutral votes have one."""
    sided = F.col("stance").isin("supports", "refutes") & (F.col("score") >= floor)
    rank = lambda score: F.struct(score, *([F.col(order)] if order else []), -F.col("pos"))
    side = F.max_by(F.struct("stance", "score", "pos"), F.when(sided, rank(F.col("score"))))
    calm = F.when(F.col("stance") == "neutral", F.col("score")) if neutral is None else F.col(neutral)
    none = F.max_by(F.struct(F.lit("neutral").alias("stance"), calm.alias("score"), "pos"), F.when(calm.isNotNull(), rank(calm)))
    out = votes.groupBy(*keys).agg(F.when(F.count_if(sided) > 0, side).otherwise(none).alias("v"))
    return out.select(*keys, F.coalesce("v.stance", F.lit("neutral")).alias("stance"), F.coalesce("v.score", F.lit(0.0)).alias("score"), F.col("v.pos").alias("pos"))


def decided(evidence: DataFrame, votes: DataFrame | None) -> DataFrame:
    """stance, score, method and misleading of each item.

    By order: another claim, no model or no text (unavailable), no relevant passage (off_topic), the model (nli); then
    a publisher's rating overrides all but the gate. votes: claim_id, evidence_id, pos, stance, score.
    """
    df = gated(evidence)
    raw = text.rating_stance(F.coalesce("rating_raw", "rating"))
    if votes is not None:
        best = strongest(votes, ["claim_id", "evidence_id"]).select("claim_id", F.col("evidence_id").alias("id"), F.col("stance").alias("__s"), F.col("score").alias("__v"))
        df = df.join(best, ["claim_id", "id"], "left")
    else:
        df = df.withColumn("__s", F.lit(None).cast("string")).withColumn("__v", F.lit(None).cast("double"))
    away = F.col("gate") == "not_about"
    has_text = text.body(F.col("title"), F.col("snippet"), F.col("text")) != ""
    method = F.when(away, "not_about").when(raw.isNotNull(), "rating").when(F.col("__s").isNotNull(), "nli").when(~has_text | F.lit(votes is None), "unavailable").otherwise("off_topic")
    stance = F.when(away, "neutral").when(raw == "refute", "refutes").when(raw == "support", "supports").when(raw == "neutral", "neutral").otherwise(F.coalesce("__s", F.lit("neutral")))
    score = F.when(away, 0.0).when(raw == "neutral", 0.5).when(raw.isNotNull(), 1.0).otherwise(F.coalesce("__v", F.lit(0.0)))
    return df.withColumns({"method": method, "stance": stance, "stance_score": vectors.clamp(score), "misleading": ~away & (F.col("rating") == "misleading")}).drop("__s", "__v")


def judged(evidence: DataFrame, claims: DataFrame, load=scoring.word_overlap, name: str = "words", floor: float = 0.3, k: int = 3, batch: int = 8, read=text.content_terms, alike=term_cosine) -> DataFrame:
    """Every item with stance, stance_score, relevance, best_passage, method, misleading and note, from its text.

    Items that passed the gate are cut into passages; of each, the ``k`` most similar to the claim at or above
    ``floor`` are scored against it, all claims' together, in batches (``scoring.score_pairs``). The strongest side
    decides (``strongest``); then a publisher's rating overrides all but the gate.

    Methods: not_about, rating, nli, off_topic (a text, but no passage is similar), unavailable (no claim, no text, or
    the model failed on every passage; ``note`` says which). Items of claims that are not in ``claims`` are neutral.
    """
    known = claims.select("claim_id", F.trim(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''").dropDuplicates(["claim_id"])
    df = gated(evidence).join(known.select("claim_id", F.lit(True).alias("__claim")), "claim_id", "left")
    checkpointing(evidence.sparkSession)
    ranks = ranked(df.where("__claim"), known, floor, k, read, alike).checkpoint()  # read more than once
    asked = ranks.where("relevant").join(known.withColumnRenamed("text", "hypothesis"), "claim_id")
    got = scoring.votes(scoring.score_pairs(asked.select("claim_id", "evidence_id", "pos", "similarity", F.col("passage").alias("premise"), "hypothesis"), load, name, ["claim_id", "evidence_id", "pos"], batch=batch)).checkpoint()
    keys = ["claim_id", "evidence_id"]
    of = ranks.groupBy(*keys).agg(F.max("best").alias("__best"), F.min_by("passage", F.when(F.col("relevant"), F.col("rank"))).alias("__top"), F.count_if("relevant").alias("__relevant"))
    cast = got.where("stance IS NOT NULL").withColumns({"pos": F.col("pos").cast("long"), "neutral": F.round(F.col("scores")["neutral"], 4)})
    won = strongest(cast, keys, order="similarity", neutral="neutral").withColumnRenamed("pos", "__pos")
    failed = got.groupBy(*keys).agg(F.min("error").alias("__error"))
    used = got.select(*keys, F.col("pos").cast("long").alias("__pos"), F.col("similarity").alias("__used"), F.col("premise").alias("__read"))
    model = of.join(failed, keys, "left").join(won.join(used, [*keys, "__pos"], "left").withColumnRenamed("stance", "__s").withColumnRenamed("score", "__v"), keys, "left").withColumnRenamed("evidence_id", "id")
    df = df.join(model, ["claim_id", "id"], "left")
    raw = text.rating_stance(F.coalesce("rating_raw", "rating"))
    away, read = F.col("gate") == "not_about", F.col("__best").isNotNull()
    own = F.when(~read, "unavailable").when(F.col("__relevant") == 0, "off_topic").when(F.col("__s").isNull(), "unavailable").otherwise("nli")
    method = F.when(away, "not_about").when(raw.isNotNull(), "rating").otherwise(own)
    sides = {"refute": "refutes", "support": "supports", "neutral": "neutral"}
    rated = F.element_at(F.create_map(*[F.lit(x) for p in sides.items() for x in p]), raw)
    stance = F.when(away, "neutral").when(raw.isNotNull(), rated).otherwise(F.coalesce("__s", F.lit("neutral")))
    score = F.when(away, 0.0).when(raw == "neutral", 0.5).when(raw.isNotNull(), 1.0).otherwise(F.coalesce("__v", F.lit(0.0)))
    none = F.lit(None).cast("string")
    note = F.when(away, F.lit("rating withheld: about another claim")).when(F.col("__claim").isNull(), "claim has no text").when(~read, "no evidence text").when(F.col("__relevant") == 0, "no passage cleared the relevance cutoff").when(F.col("__s").isNull(), F.coalesce("__error", F.lit("model unavailable"))).otherwise(none)
    misleading = ~away & F.coalesce((raw == "refute") & (F.col("__s") == "supports"), F.lit(False))
    out = df.withColumns({
        "method": method, "stance": stance, "stance_score": F.round(vectors.clamp(score), 4), "misleading": misleading, "note": note,
        "relevance": F.when(away, 0.0).otherwise(F.round(vectors.clamp(F.coalesce("__used", "__best", F.lit(0.0))), 4)),
        "best_passage": F.when(away, none).when(raw.isNotNull(), F.col("__top")).when(own == "nli", F.col("__read")).when(own == "unavailable", F.col("__top")),
    })
    return out.drop("__claim", "__best", "__top", "__relevant", "__error", "__pos", "__s", "__v", "__used", "__read")


def report(stances: DataFrame) -> DataFrame:
    return stances.groupBy("method", "stance").agg(F.count("*").alias("n"), F.count_if(F.col("misleading")).alias("misleading"))
