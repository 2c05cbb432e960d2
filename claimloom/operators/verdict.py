"""Weighted stances, the verdict cascade and the roll-up to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import vocab as V


def weight(w: Column) -> Column:
    """A zero or missing weight counts as 0.5."""
    return F.when(F.coalesce(w, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(w)


def weighted(score: Column, w: Column) -> Column:
    """score x weight to four places; a missing score counts as 1."""
    return F.round(F.coalesce(score, F.lit(1.0)) * weight(w), 4)


def totals(stances: DataFrame, key: str = "claim_id") -> DataFrame:
    """Each key's weighted sums by side, margin and counts. stances: key, stance, score, weight, decisive, demo."""
    w = weighted(F.col("score"), F.col("weight"))
    side = lambda s: F.round(F.coalesce(F.sum(F.when(F.col("stance") == s, w)), F.lit(0.0)), 4)
    sided = F.col("stance").isin("supports", "refutes")
    out = stances.groupBy(key).agg(
        side("supports").alias("supports"), side("refutes").alias("refutes"), side("neutral").alias("neutral"),
        F.count_if(F.col("stance") == "supports").alias("n_supports"), F.count_if(F.col("stance") == "refutes").alias("n_refutes"), F.count_if(F.col("stance") == "neutral").alias("n_neutral"),
        F.count_if(F.col("stance").isNull()).alias("n_unscored"), F.count_if(sided & F.col("decisive")).alias("n_decisive"), F.count("*").alias("n_evidence"),
        (F.bool_and(F.coalesce("demo", F.lit(False))) & (F.count("*") > 0)).alias("demo_only"),
    )
    return out.withColumn("margin", F.round(F.col("supports") - F.col("refutes"), 4))


def decisive_hits(stances: DataFrame) -> DataFrame:
    """Each claim's decisive item of the highest weight: its stance and rating."""
    rows = stances.where(F.col("decisive") & F.col("stance").isin("supports", "refutes"))
    top = F.max_by(F.struct("stance", "rating", "id"), F.struct(weighted(F.col("score"), F.col("weight")), weight(F.col("weight")), F.col("id")))
    return rows.groupBy("claim_id").agg(top.alias("t")).select("claim_id", F.col("t.stance").alias("hit_stance"), F.col("t.rating").alias("hit_rating"), F.col("t.id").alias("hit_id"))


def recycled(claims: DataFrame, claim_images: DataFrame, images: DataFrame) -> DataFrame:
    """Claims behind which a flagged picture stands: one of their own, or, if they have none, any of the message.

    claims: packet_id, claim_id. claim_images: claim_id, image_id. images: packet_id, image_id, date_mismatch.
    """
    flagged = images.where("date_mismatch")
    own = claim_images.join(flagged.select("image_id"), "image_id", "left_semi").select("claim_id")
    without = claims.join(claim_images.select("claim_id"), "claim_id", "left_anti").join(flagged.select("packet_id"), "packet_id", "left_semi").select("claim_id")
    return own.unionByName(without).distinct()


def cascade(df: DataFrame) -> DataFrame:
    """label, rule and confidence from totals, hit_stance, hit_rating, recycled and mismatched (all but totals may be null)."""
    s, r = F.coalesce("supports", F.lit(0.0)), F.coalesce("refutes", F.lit(0.0))
    against, favour = (r >= V.MIN_WEIGHT) & (r >= s * V.DOMINANCE), (s >= V.MIN_WEIGHT) & (s >= r * V.DOMINANCE)
    rules = [
        (F.col("hit_stance").isNotNull(), "decisive", F.when(F.col("hit_rating") == "misleading", "misleading").when(F.col("hit_stance") == "supports", "true").otherwise("false"), F.lit(V.CONFIDENCE["decisive"])),
        (F.coalesce("recycled", F.lit(False)), "recycled", F.lit("misleading"), F.lit(V.CONFIDENCE["recycled"])),
        (F.coalesce("mismatched", F.lit(False)), "mismatch", F.lit("misleading"), F.lit(V.CONFIDENCE["mismatch"])),
        (against, "weighted", F.lit("false"), F.least(F.lit(0.85), F.lit(0.5) + r / 4)), (favour, "weighted", F.lit("true"), F.least(F.lit(0.85), F.lit(0.5) + s / 4)),
        ((s > 0) & (r > 0), "disputed", F.lit("disputed"), F.lit(V.CONFIDENCE["disputed"])),
    ]
    label, rule, conf = F, F, F
    for cond, name, value, confidence in rules:
        label, rule, conf = label.when(cond, value), rule.when(cond, F.lit(name)), conf.when(cond, confidence)
    df = df.withColumns({"label": label.otherwise("unverified"), "rule": rule.otherwise("unverified"), "confidence": conf.otherwise(F.lit(V.CONFIDENCE["unverified"]))})
    demo = F.coalesce("demo_only", F.lit(False)) & (F.col("label") != "unverified")
    return df.withColumn("confidence", F.when(demo, F.col("confidence") * V.DEMO_DISCOUNT).otherwise(F.col("confidence")))


def for_claims(claims: DataFrame, stances: DataFrame, recycled_: DataFrame | None = None, mismatched: DataFrame | None = None) -> DataFrame:
    """Verdicts of all claims (packet_id, claim_id), with or without evidence."""
    df = claims.join(totals(stances), "claim_id", "left").join(decisive_hits(stances), "claim_id", "left")
    for name, other in (("recycled", recycled_), ("mismatched", mismatched)):
        df = df.join(other.select("claim_id").distinct().withColumn(name, F.lit(True)), "claim_id", "left") if other is not None else df.withColumn(name, F.lit(False))
    return cascade(df)


def severity(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in V.SEVERITY]), label).cast("int")


def roll_up(verdicts: DataFrame, key: str = "packet_id") -> DataFrame:
    """Each message's verdict: the worst label, the surest claim of it, counts by label and a summary."""
    worst = F.min_by(F.struct("label", "confidence", "claim_id"), F.struct(severity(F.col("label")), -F.col("confidence"), F.col("claim_id")))
    counts = [F.count_if(F.col("label") == x).alias(f"n_{x}") for x in V.SEVERITY]
    out = verdicts.groupBy(key).agg(worst.alias("w"), *counts, F.count("*").alias("n_claims"))
    parts = F.concat_ws(", ", *[F.when(F.col(f"n_{x}") > 0, F.concat(F.col(f"n_{x}").cast("string"), F.lit(f" {x}"))) for x in V.SEVERITY])
    return out.select(key, F.col("w.label").alias("label"), F.col("w.confidence").alias("confidence"), F.col("w.claim_id").alias("worst_claim"), *[f"n_{x}" for x in V.SEVERITY], "n_claims", F.concat(F.col("n_claims").cast("string"), F.lit(" claims: "), parts).alias("summary"))


def described(publisher: Column, domain: Column, rating: Column, date: Column, title: Column, demo: Column) -> Column:
    """An item as a phrase."""
    given = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    phrase = F.concat_ws(" ", F.coalesce(given(publisher), given(domain), F.lit("an unnamed source")), F.when(given(rating).isNotNull() & (rating != "unknown"), F.concat(F.lit("rated it "), rating)), F.when(given(date).isNotNull(), F.concat(F.lit("on "), date)))
    phrase = F.when(given(title).isNotNull(), F.concat(phrase, F.lit(": "), F.substring(given(title), 1, 120))).otherwise(phrase)
    return F.when(F.coalesce(demo, F.lit(False)), F.concat(phrase, F.lit("  [demo data]"))).otherwise(phrase)


def described_other(publisher: Column, domain: Column, title: Column, demo: Column) -> Column:
    """An item about a similar but different claim: its rating stays unsaid."""
    given = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    phrase = F.concat(F.coalesce(given(publisher), given(domain), F.lit("A fact-checker")), F.lit(" has checked a similar-sounding claim"), F.when(given(title).isNotNull(), F.concat(F.lit(" ("), F.substring(given(title), 1, 120), F.lit(")"))).otherwise(F.lit("")), F.lit(", which is not this one"))
    return F.when(F.coalesce(demo, F.lit(False)), F.concat(phrase, F.lit("  [demo data]"))).otherwise(phrase)


def reasons(items: DataFrame, most: int = 3) -> DataFrame:
    """claim_id, reasons: the first phrases by weighted score, weight, id."""
    order = F.struct(-weighted(F.col("score"), F.col("weight")), -weight(F.col("weight")), F.col("id"), described(*[F.col(c) for c in ("publisher", "domain", "rating", "published_date", "title", "demo")]).alias("phrase"))
    return items.groupBy("claim_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["phrase"]), 1, most).alias("reasons"))
