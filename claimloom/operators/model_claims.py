"""Claims as a language model answers them, as JSON: read as VARIANT, each field with its own fallback."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import entities as E
from claimloom.functions import ids, text, vectors
from claimloom.functions import vocab as V
from claimloom.operators import claims as C

ANSWER = "array<struct<text:string,claim_type:string,confidence:double,attributed_to:string,time:string,entities:array<struct<text:string,label:string>>>>"


def _string(v: Column, path: str) -> Column:
    """A field that is a string; other kinds are as good as absent."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def claims_of(answer: Column) -> Column:
    """The claims of an answer ``{"claims": [...]}``, in order; an answer that is no such object has none.

    A claim needs a text that is not blank. An unknown or missing type is generic; a confidence that is no number (or
    text of one, or true or false) is 0.5, and others are clamped to 0..1, NaN to 1; who said it and when are null if
    missing, empty or no strings; entities without a text or of unknown kinds go.
    """
    items = F.try_variant_get(F.try_parse_json(answer), "$.claims", "array<variant>")
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def entity(v: Column) -> Column:
        return F.struct(trim(_string(v, "$.text")).alias("text"), _string(v, "$.label").alias("label"))

    def one(v: Column) -> Column:
        kind, sure = _string(v, "$.claim_type"), F.try_variant_get(v, "$.confidence", "double")
        found = F.filter(F.transform(F.try_variant_get(v, "$.entities", "array<variant>"), entity), lambda e: (F.coalesce(e["text"], F.lit("")) != "") & e["label"].isin(*V.MODEL_LABELS))
        return F.struct(
            trim(_string(v, "$.text")).alias("text"), F.when(kind.isin(*schemas.CLAIM_TYPES), kind).otherwise("generic").alias("claim_type"),
            F.when(F.isnan(sure), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(0.5))))).alias("confidence"), _given(_string(v, "$.attributed_to")).alias("attributed_to"),
            _given(_string(v, "$.time")).alias("time"), F.coalesce(found, F.array().cast("array<struct<text:string,label:string>>")).alias("entities"),
        )

    return F.coalesce(F.filter(F.transform(items, one), lambda c: F.coalesce(c["text"], F.lit("")) != ""), F.array().cast(ANSWER))


def place(field: Column, claim: Column, sentences: Column) -> Column:
    """struct<start, end> of a claim in its field: literally without case, else its most similar sentence from 0.3 (the first of equal ones), else all."""
    at = F.instr(F.lower(field), F.lower(claim))
    like = F.transform(sentences, lambda s, i: F.struct(vectors.jaccard(text.token_set(s["text"]), text.token_set(claim)).alias("j"), (-i).alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    best = F.array_max(like)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(at > 0, span(at - 1, at - 1 + F.length(claim))).when(best["j"] >= 0.3, span(best["start"], best["end"])).otherwise(span(F.lit(0), F.length(field)))


def extract(packets: DataFrame, answers: DataFrame, today: dt.date, worthy: float = V.WORTHY / 1000) -> tuple[DataFrame, DataFrame]:
    """(claims, dropped) of messages from a model's answers (packet_id, pos, answer: one for each field).

    Type and confidence are the model's. Its entities are put where the claim's text has them; patterns win over them,
    and names by capitals are left out. Claims below ``worthy`` are dropped (llm_low_confidence), and so are sentences
    that no claim covers (llm_not_claim). Near-duplicates of a message go, the first stays. A field without an answer
    has no claims and drops all its sentences.
    """
    fields = C.fields_of(packets)
    cut = fields.join(answers.select("packet_id", "pos", "answer"), ["packet_id", "pos"], "left")
    cut = C.settled(cut, {"spans": text.sentence_spans(F.col("text")), "found": claims_of(F.col("answer"))})
    rows = cut.select("packet_id", "field", "image_index", "frame_time", "pos", "text", "spans", F.posexplode("found").alias("n", "c"))
    rows = rows.select("*", F.col("c.text").alias("sentence"), "c.claim_type", F.round("c.confidence", 3).alias("confidence"), "c.attributed_to", F.col("c.time").alias("model_time"), F.col("c.entities").alias("named"))
    rows = C.settled(rows, {"place": place(F.col("text"), F.col("sentence"), F.col("spans")), "patterned": F.filter(E.entities(F.col("sentence"), today), lambda e: ~e["label"].isin(*V.NAMED))})
    rows = C.settled(rows, {"entities": E.merged(F.col("patterned"), E.anchored(F.col("sentence"), F.col("named")))})
    rows = C.settled(rows, {"times": E.times(F.col("sentence"), today, F.col("entities")), "normalized_text": text.normalize(F.col("sentence"))})
    rows = rows.withColumns({
        "start": F.col("place.start"), "end": F.col("place.end"), "check_worthy": F.col("confidence") >= worthy, "language": text.language(F.col("sentence")), "claim_id": ids.claim_id(F.col("packet_id"), F.col("normalized_text")),
        "numbers": F.transform(F.filter("entities", lambda e: e["label"].isin(*V.QUANTIFIED)), lambda e: F.coalesce(e["normalized"], e["text"])),
    }).drop("c", "place", "patterned", "named", "text", "spans")
    low = rows.where("NOT check_worthy").select("packet_id", "field", "pos", F.col("sentence").alias("text"), "confidence", F.lit("llm_low_confidence").alias("reason"))
    covered = C.settled(cut, {"covered": F.transform("found", lambda c: place(F.col("text"), c["text"], F.col("spans")))})
    left = F.filter("spans", lambda s: ~F.exists("covered", lambda c: (s["start"] < c["end"]) & (s["end"] > c["start"])))
    rest = covered.select("packet_id", "field", "pos", F.explode(left).alias("s")).select("packet_id", "field", "pos", F.col("s.text").alias("text"), F.lit(0.0).alias("confidence"), F.lit("llm_not_claim").alias("reason"))
    return C.deduped(rows.where("check_worthy"), "packet_id", ["pos", "n"]), low.unionByName(rest)
