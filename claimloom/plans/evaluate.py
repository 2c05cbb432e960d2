"""The engine over labelled cases, in modes that each report only what they measure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.operators import evaluation
from claimloom.plans import lifecycle
from claimloom.sources import readers
from claimloom.sources.folders import checkpointing

#: Which stages a mode has: evidence, verdicts.
MODES = {"claims": (False, False), "retrieval": (True, False), "full": (True, True)}


def _errors(done: lifecycle.Checked, claims: DataFrame) -> DataFrame:
    """packet_id, evidence, stance: what failed for a message's claims. A table that failed fails every message with claims."""
    mine = claims.select("packet_id", "claim_id")
    lost = done.failures.where("claim_ids IS NOT NULL").select(F.explode("claim_ids").alias("claim_id"), F.concat_ws(": ", "source", "error").alias("error")).join(mine, "claim_id").select("packet_id", "error")
    whole = F.array(*[F.lit(f"{r['source']}: {r['error']}") for r in done.failures.where("claim_ids IS NULL").collect()]).cast("array<string>")  # one row a source at most
    all_ = mine.select("packet_id", F.explode(whole).alias("error"))
    out = lost.unionByName(all_).groupBy("packet_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("evidence"))
    if done.stances is None or "note" not in done.stances.columns:
        return out.withColumn("stance", F.lit(None).cast("string"))
    told = ["rating withheld: about another claim", "claim has no text", "no evidence text", "no passage cleared the relevance cutoff"]
    failed = done.stances.where(F.col("note").isNotNull() & ~F.col("note").isin(*told)).select("claim_id", "note").join(mine, "claim_id").groupBy("packet_id").agg(F.min("note").alias("stance"))
    return out.join(failed, "packet_id", "full")


def run(cases: DataFrame, today: dt.date, sources: lifecycle.Sources, tiers: DataFrame | None = None, modes: tuple[str, ...] = ("claims", "retrieval", "full"), lexicon: text.Lexicon | None = None, model=None, plain: bool = False, languages: tuple[str, ...] = ("en", "hi", "hinglish")) -> tuple[DataFrame, lifecycle.Checked]:
    """(records, tables): one record for each case and mode.

    cases: id, text, language, category, expect struct<verdict, check_worthy, retrieves>, in_corpus. All modes read one
    run, whose stages are made once: ``claims`` its claims, ``retrieval`` the corpus entries found as well, ``full``
    verdicts too. What a mode does not measure is null. Cases of one text share its claims. A case that is not valid
    (``evaluation.valid_cases``) is not run, and says why under ``runner`` in ``stage_errors``; a source or model that
    failed for a case stands there too, so that it does not look like finding nothing.
    """
    unknown = [m for m in modes if m not in MODES]
    if unknown:
        raise ValueError(f"unknown modes {unknown}; there are {list(MODES)}")
    retrieve, judge = (any(MODES[m][k] for m in modes) for k in (0, 1))
    # written once: claims, messages and records all read them
    checkpointing(cases.sparkSession)
    cases = evaluation.valid_cases(cases, languages).checkpoint()
    texts = readers.text_packets(cases.where("size(problems) = 0"), keys=["id"])
    done = lifecycle.run(texts.drop("id"), today, sources if retrieve else None, tiers, lexicon, model, judge, plain)
    worthy = done.claims.where("check_worthy").dropDuplicates(["claim_id"])
    by = texts.select("id", "packet_id").join(worthy.groupBy("packet_id").agg(F.count("*").alias("n_claims")), "packet_id", "left").fillna(0, ["n_claims"])
    none = {"retrieved_seed_ids": "array<string>", "verdict": "string", "confidence": "double", "evidence": "string", "stance": "string"}
    if retrieve:
        seeds = done.evidence.where("source_type = 'seed_index'").join(worthy.select("claim_id", "packet_id"), "claim_id").groupBy("packet_id").agg(F.array_sort(F.collect_set("item_id")).alias("retrieved_seed_ids"))
        by = by.join(seeds, "packet_id", "left").withColumn("retrieved_seed_ids", F.coalesce("retrieved_seed_ids", F.array().cast("array<string>"))).join(_errors(done, worthy), "packet_id", "left")
    if judge:
        by = by.join(done.packets.select("packet_id", F.col("label").alias("verdict"), "confidence"), "packet_id", "left")
    by = by.select("id", "n_claims", *[F.col(c) if c in by.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])
    rows = cases.join(by, "id", "left").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    found, judged = F.col("mode").isin(*[m for m in modes if MODES[m][0]]), F.col("mode").isin(*[m for m in modes if MODES[m][1]])
    ran = F.size("problems") == 0
    errors = F.map_filter(F.map_from_arrays(F.array(F.lit("runner"), F.lit("evidence"), F.lit("stance")), F.array(F.when(~ran, F.array_join("problems", "; ")), F.when(found, F.col("evidence")), F.when(judged, F.col("stance")))), lambda _, v: v.isNotNull())
    records = rows.select(
        "id", "language", "category", "mode", F.when(judged, F.col("verdict")).alias("verdict"), F.col("expect.verdict").alias("expected_verdict"), F.when(ran, F.col("n_claims") > 0).alias("check_worthy"),
        F.col("expect.check_worthy").alias("expected_check_worthy"), F.col("expect.retrieves").alias("expected_seed_id"), F.when(found & ran, F.col("retrieved_seed_ids")).alias("retrieved_seed_ids"), "in_corpus",
        F.when(ran, F.col("n_claims")).alias("n_claims"), F.when(judged, F.round("confidence", 4)).alias("confidence"), errors.alias("stage_errors"),
    )
    return records, done
