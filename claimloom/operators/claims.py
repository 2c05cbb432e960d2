"""Sentences of packets, their features, scores, types, reasons and near-duplicates."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import entities as E
from claimloom.functions import ids, phrases, text, vectors
from claimloom.functions import vocab as V

FEATURES = {
    "question": rf"\?\s*$|{text.leading(V.QUESTION_START)}",
    "opinion": text.whole(V.OPINION),
    "personal": rf"{text.leading(V.PERSONAL_START)}|{text.whole(V.PERSONAL)}",
    "person_marked": text.whole(V.PERSON_MARKED),
    "greeting": rf"(?i)^\s*(?:{V.GREETING})[\s!.]*$",
    "imperative_only": rf"(?i)^\s*(?:please\s+)?(?:{V.IMPERATIVE_START})(?:$|[^{text.W}])",
    "has_verb": text.whole(V.VERB),
    "attribution": text.whole(V.ATTRIBUTION),
    "policy": text.whole(V.POLICY),
    "health": text.whole(V.HEALTH),
    "chain_offer": text.whole(V.CHAIN_OFFER),
    "prediction": text.whole(V.PREDICTION),
    "causal": text.whole(V.CAUSAL),
    "event": text.whole(V.EVENT),
    "urgency": text.whole(V.URGENCY),
}

#: The features that are words and phrases anywhere in a sentence, as sets; the others look at how it begins or ends.
ANYWHERE = {
    name: phrases.Phrases.of(words)
    for name, words in {
        "opinion": V.OPINION, "personal": V.PERSONAL, "person_marked": V.PERSON_MARKED, "has_verb": V.VERB, "attribution": V.ATTRIBUTION, "policy": V.POLICY, "health": V.HEALTH, "chain_offer": V.CHAIN_OFFER,
        "prediction": V.PREDICTION, "causal": V.CAUSAL, "event": V.EVENT, "urgency": V.URGENCY, "time_ref": rf"{V.MONTHS}|(?:19|20)\d{{2}}|{V.RELATIVE}|{V.RECURRING}",
    }.items()
}
_EDGES = {"question": FEATURES["question"], "personal": text.leading(V.PERSONAL_START), "greeting": FEATURES["greeting"], "imperative_only": FEATURES["imperative_only"]}

#: What ``with_plain_entities`` looks for.
_NUMBER = rf"(?:^|[^{text.W}.])\d[\d,]*(?:\.\d+)?(?:$|[^{text.W}.])"
PLAIN = {
    "named_entity": r"[^\s.!?:]\s+[A-Z][a-zA-Z]{2,}|^[A-Z][a-zA-Z]+\s+[A-Z][a-zA-Z]+",
    "quantity": rf"{_NUMBER}|\d\s?%",
    "money": rf"(?i)(?:₹|\$|€|(?:^|[^{text.W}])(?:Rs\.?|INR|USD))\s?\d",
    "percent": r"\d\s?%",
    "number": _NUMBER,
    "url": r"(?i)https?://\S|www\.\S",
    "contact": r"(?:^|[^\d])[6-9]\d{9}(?:$|[^\d])",
    "time_ref": text.whole(rf"{V.MONTHS}|(?:19|20)\d{{2}}|{V.RELATIVE}|{V.RECURRING}"),
}


def fields_of(packets: DataFrame) -> DataFrame:
    """packet_id, field, image_index, frame_time, pos, text: the message's own text, then each image's words and caption.

    Their order is the order of precedence for near-duplicates.
    """
    kind = "struct<field:string,image_index:int,frame_time:double,text:string>"

    def of_image(image: Column, k: Column) -> Column:
        part = lambda name, c: F.struct(F.lit(name).alias("field"), k.alias("image_index"), image["frame_time"].alias("frame_time"), c.alias("text"))
        return F.array(part("ocr", image["ocr_text"]), part("caption", image["description"]))

    own = F.struct(F.lit("text").alias("field"), F.lit(None).cast("int").alias("image_index"), F.lit(None).cast("double").alias("frame_time"), F.col("text").alias("text"))
    images = F.coalesce(F.flatten(F.transform("images", of_image)), F.array().cast(f"array<{kind}>"))
    return packets.select("packet_id", F.posexplode(F.concat(F.array(own), images)).alias("pos", "f")).select("packet_id", "f.field", "f.image_index", "f.frame_time", "pos", "f.text").where(F.coalesce("text", F.lit("")) != "")


def sentence_rows(fields: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row a sentence: the keys, ``n`` (from 0) and ``sentence`` with its white space squeezed."""
    rows = fields.select(*keys, F.posexplode(text.sentences(text.clean(F.col(text_col)))).alias("n", "sentence"))
    return rows.withColumn("sentence", text.squeezed(F.col("sentence"))).where("sentence <> ''")


def _read(s: Column) -> Column:
    """struct<words, known, digits> of a sentence: what features look up."""
    words = phrases.words_of(s)
    return F.transform(F.array(words), lambda w: F.struct(w.alias("words"), phrases.known(w, ANYWHERE).alias("known"), s.rlike("[0-9]").alias("digits")))[0]


def _shown(name: str, s: Column, read: Column) -> Column:
    out = F.lit(False)
    if name in ANYWHERE:
        out = ANYWHERE[name].found(s, read["words"], read["known"], read["digits"])
    return out | s.rlike(_EDGES[name]) if name in _EDGES else out


def with_features(df: DataFrame, col: str = "sentence", lexicon: text.Lexicon | None = None, plain: bool = False) -> DataFrame:
    """One boolean a feature, true if any spelling of the sentence shows it, and ``tokens``.

    A sentence is cut into words once; a feature looks up those that any feature knows, and tries the pattern of its
    phrases only if a word is there that one begins with. Flags are those of the patterns in ``FEATURES``. ``plain``
    adds those of ``with_plain_entities`` from the same words.
    """
    df = settled(df, {"__s": F.coalesce(F.col(col), F.lit("")), "__o": F.lit("") if lexicon is None else F.coalesce(lexicon.romanised(F.col(col)), F.lit(""))})
    df = settled(df, {"__r": _read(F.col("__s")), "__p": _read(F.col("__o")) if lexicon is not None else F.lit(0)})
    found = {}
    for name in FEATURES:
        one = _shown(name, F.col("__s"), F.col("__r"))
        found[name] = one if lexicon is None else one | _shown(name, F.col("__o"), F.col("__p"))
    if plain:
        found |= _plain(F.col("__s"), F.col("__r"))
    return settled(df, found | {"tokens": text.n_tokens(F.col(col))}).drop("__s", "__o", "__r", "__p")


def with_spans(df: DataFrame, today: dt.date, col: str = "sentence", tagged: Column | None = None) -> DataFrame:
    """``entities`` and ``times`` of a sentence; ``tagged`` are a model's spans (``entities.model_entities`` or ``anchored``)."""
    df = settled(df, {"entities": E.entities(F.col(col), today, tagged)})
    return settled(df, {"times": E.times(F.col(col), today, F.col("entities"))})


def with_entities(df: DataFrame, today: dt.date, col: str = "sentence", tagged: Column | None = None) -> DataFrame:
    """``entities`` and ``times``, and what scoring reads of them."""
    df = with_spans(df, today, col, tagged)
    has = lambda labels: F.exists("entities", lambda e: e["label"].isin(*labels))
    return settled(df, {
        "named_entity": has(V.NAMED), "quantity": has(V.QUANTIFIED), "money": has(["MONEY"]), "percent": has(["PERCENT"]), "number": has(["NUMBER"]),
        "url": has(["URL"]), "contact": has(["PHONE", "UPI"]), "time_ref": F.size("times") > 0,
    })


def with_plain_entities(df: DataFrame, col: str = "sentence") -> DataFrame:
    """The same flags from patterns alone: for scans where only the score counts.

    Names need two capitalised words, or one that does not begin the sentence; times are numbers of four digits from 19
    or 20 and month or day words. It is a narrower reading than ``with_entities``.
    """
    df = settled(df, {"__s": F.coalesce(F.col(col), F.lit(""))})
    df = settled(df, {"__r": _read(F.col("__s"))})
    return settled(df, _plain(F.col("__s"), F.col("__r"))).drop("__s", "__r")


def _plain(s: Column, r: Column) -> dict[str, Column]:
    digits = ("quantity", "money", "percent", "number", "contact")
    found = {name: s.rlike(pattern) if name not in digits else r["digits"] & s.rlike(pattern) for name, pattern in PLAIN.items() if name != "time_ref"}
    return found | {"time_ref": _shown("time_ref", s, r)}


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The frame with further columns, made by a generator of one row.

    A filter on such a column stays above it and constraints don't enter it; with plain columns a filter on a score is
    written out in terms of all features, which are then evaluated once more, and inferring constraints takes minutes.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def points() -> Column:
    """The score in thousandths, before hard rejects."""
    f = F.col
    topical = f("policy") | f("health") | f("event")
    firm = f("attribution") | topical | f("chain_offer") | f("quantity") | f("urgency") | f("contact") | f("url")
    gains = {**{k: f(k) for k in V.GAINS if k != "topical"}, "topical": topical}
    losses = {"question": f("question"), "opinion": f("opinion"), "personal": (f("personal") | f("person_marked")) & ~firm, "imperative_only": f("imperative_only") & ~(f("quantity") | f("chain_offer"))}
    total = F.lit(V.BASE)
    for k, on in gains.items():
        total = total + F.when(on, V.GAINS[k]).otherwise(0)
    for k, on in losses.items():
        total = total - F.when(on, V.LOSSES[k]).otherwise(0)
    return F.least(F.greatest(total, F.lit(0)), F.lit(1000))


def claim_type() -> Column:
    """The most specific type that fits; the first rule wins."""
    f = F.col
    rules = [
        (f("chain_offer") & (f("contact") | f("imperative_only") | f("money")), "chain_offer"), (f("health"), "health"), (f("policy"), "policy"),
        (f("attribution"), "attribution"), (f("money"), "money"), (f("percent"), "statistic"), (f("event"), "event"), (f("number") & f("has_verb"), "statistic"),
        (f("causal"), "causal"), (f("prediction"), "prediction"), (f("time_ref"), "event"), (f("chain_offer"), "chain_offer"),
    ]
    out = F.when(*rules[0])
    for cond, name in rules[1:]:
        out = out.when(cond, name)
    return out.otherwise("generic")


def drop_reason() -> Column:
    """Why a sentence is no claim, by precedence; null for one that is."""
    f = F.col
    out = F.when(f("check_worthy"), None)
    if_model = f("points") >= V.WORTHY
    for cond, name in ((if_model, "model_not_claim"), (f("greeting"), "greeting"), (f("tokens") < V.LEAST_TOKENS, "too_short"), (f("tokens") > V.MOST_TOKENS, "too_long"), (f("question"), "question"), (f("opinion"), "opinion"), (f("personal"), "personal"), (f("imperative_only"), "imperative_only")):
        out = out.when(cond, name)
    return out.otherwise("low_signal")


def modelled_type(probabilities: Column) -> Column:
    """A model's likeliest type (map<type, probability>), null where it is unknown or the next comes within the margin."""
    best = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    first, margin = F.get(best, F.lit(0)), F.coalesce(F.get(best, F.lit(1))["p"], F.lit(0.0)) - F.get(best, F.lit(0))["p"]
    return F.when(first["k"].isin(*V.RISK) & (margin >= V.TYPE_MARGIN), first["k"])


def scored(df: DataFrame, model: Column | None = None, typed: Column | None = None) -> DataFrame:
    """points, confidence, check_worthy, claim_type and drop_reason from features and entity flags.

    ``model``: a second opinion (0 to 1, or null) that weighs half, except on hard rejects. ``typed``: a model's
    probabilities by type; its type replaces the rules' unless that is one of the sticky ones, or a hard reject.
    """
    reject = F.col("greeting") | (F.col("tokens") < V.LEAST_TOKENS) | (F.col("tokens") > V.MOST_TOKENS)
    df = settled(df, {"points": F.when(reject, F.lit(0)).otherwise(points())})
    own = F.col("points") / F.lit(1000)
    mixed = own if model is None else F.when(model.isNotNull() & (F.col("points") > 0), F.round((own + model) / 2, 3)).otherwise(own)
    kind = claim_type()
    if typed is not None:
        kind = F.when((F.col("points") > 0) & ~kind.isin(*V.STICKY_TYPES), F.coalesce(modelled_type(typed), kind)).otherwise(kind)
    df = settled(df, {"confidence": mixed, "check_worthy": mixed >= V.WORTHY / 1000, "claim_type": kind})
    return settled(df, {"drop_reason": drop_reason()})


def attributed_to(sentence: Column, entities: Column) -> Column:
    """Who said it: the phrase after "according to", else the last name before the reporting verb."""
    phrase = F.regexp_extract(sentence, rf"(?i:according to|as per)\s+(?i:the\s+)?([A-Z][{text.W} .&]+?)(?:,|\s+(?:the|a|an)(?:$|[^{text.W}])|$)", 1)
    verb = F.regexp_instr(sentence, F.lit(text.whole(V.ATTRIBUTION)))
    before = F.filter(entities, lambda e: e["label"].isin(*V.NAMED) & (e["end"] <= verb))
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(phrase), "[.,;:!]+$", ""), F.lit("")), F.when((verb > 0) & (F.size(before) > 0), F.element_at(before, -1)["text"]))


def extract(packets: DataFrame, today: dt.date, lexicon: text.Lexicon | None = None, model=None, typed=None, tagged=None, plain: bool = False) -> DataFrame:
    """Claims and rejected sentences of packets, one row each, near-duplicates removed.

    ``model``, ``typed`` and ``tagged`` make columns of a sentence: a second score, probabilities by type, and a
    tagger's hits (array<struct<entity_group, score, start, end>>). ``plain`` reads flags from patterns alone, and no
    entities and times.
    """
    s = F.col("sentence")
    rows = with_features(sentence_rows(fields_of(packets), ["packet_id", "field", "image_index", "frame_time", "pos"]), lexicon=lexicon, plain=plain)
    if plain:
        rows = rows.withColumns({"entities": F.array().cast(E.ENTITIES), "times": F.array().cast(E.TIMES)})
    else:
        rows = with_entities(rows, today, tagged=E.model_entities(s, tagged(s)) if tagged else None)
    rows = scored(rows, model(s) if model else None, typed(s) if typed else None)
    rows = rows.withColumns({
        "normalized_text": text.normalize(s), "language": text.language(s),
        "attributed_to": F.when(F.col("claim_type") == "attribution", attributed_to(s, F.col("entities"))),
        "numbers": F.transform(F.filter("entities", lambda e: e["label"].isin(*V.QUANTIFIED)), lambda e: F.coalesce(e["normalized"], e["text"])),
    })
    rows = rows.withColumn("claim_id", ids.claim_id(F.col("packet_id"), F.col("normalized_text")))
    return deduped(rows, "packet_id", ["pos", "n"])


def deduped(df: DataFrame, key: str, order: list[str], similar: float = 0.8, col: str = "sentence") -> DataFrame:
    """Greedy near-duplicate removal in order: a row whose token set is similar to a survivor's goes, and the survivor
    takes the higher confidence of the two. Survivors only are compared with, so A~B~C without A~C keeps A and C.

    A packet's rows travel together, so they are made once. Which rows survive is told by their token sets and
    confidences alone (``_survivors``): a row is compared only with survivors that share one of its rarer tokens.
    """
    rest = [c for c in df.columns if c not in (key, "confidence", "check_worthy")]
    t = text.token_set(F.col(col))
    struct = F.struct(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.struct(*rest).alias("__r"), t.alias("__t"), F.col("confidence").alias("__c"), F.col("check_worthy").alias("__w"))
    rows = df.groupBy(key).agg(F.collect_list(struct).alias("__a"))

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k in reversed(range(len(order))):
            out = F.when(a[f"__o{k}"] < b[f"__o{k}"], -1).when(a[f"__o{k}"] > b[f"__o{k}"], 1).otherwise(out)
        return out

    in_order = F.array_sort("__a", before) if "map<" in rows.schema["__a"].dataType.simpleString() else F.array_sort("__a")  # a map has no order
    rows = rows.select(key, in_order.alias("__a"))
    rows = rows.withColumn("__k", F.pandas_udf(_survivors, "array<struct<at:int,by:int>>")(F.transform("__a", lambda x: x["__t"]), F.transform("__a", lambda x: x["__c"].cast("double")), F.lit(similar)))
    kept = rows.select(key, F.explode(F.transform("__k", lambda k: F.struct(F.get("__a", k["at"])["__r"].alias("r"), F.get("__a", k["by"])["__c"].alias("c"), F.get("__a", k["by"])["__w"].alias("w")))).alias("k"))
    return kept.select(key, *[F.col("k.r")[c].alias(c) for c in rest], F.col("k.c").alias("confidence"), F.col("k.w").alias("check_worthy"))


def _survivors(sets: pd.Series, sure: pd.Series, similar: pd.Series) -> pd.Series:
    """Each packet's survivors: their places, and the place of the row whose confidence each takes."""

    def of(rows, sure, similar):
        count = Counter(w for s in rows for w in s)
        having, kept = {}, []  # survivors by each of their rarer tokens
        for at, words in enumerate(rows):
            words = sorted(words, key=lambda w: (count[w], w))
            # sets as similar as that share so much of the larger one that both have a token in common among these
            rarer, own = words[: len(words) - math.ceil(similar * len(words) - 1e-9) + 1], set(words)
            for k in sorted({k for w in rarer for k in having.get(w, ())}):
                other = kept[k]["words"]
                if min(len(own), len(other)) >= similar * max(len(own), len(other)) and (n := len(own & other)) / (len(own) + len(other) - n) >= similar:
                    if sure[at] > sure[kept[k]["by"]]:
                        kept[k]["by"] = at
                    break
            else:
                for w in rarer:
                    having.setdefault(w, []).append(len(kept))
                kept.append({"at": at, "by": at, "words": own})
        return [{"at": k["at"], "by": k["by"]} for k in kept]

    return pd.Series([of(*x) for x in zip(sets, sure, similar)])


def top(df: DataFrame, key: str, k: int, score: str, tie: str) -> DataFrame:
    """Each key's ``k`` rows of highest score, ties by ``tie``; row_number lets Spark limit within tasks first."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def priority() -> Column:
    """How much checking a claim matters: its confidence and the risk of its type."""
    risk = F.create_map(*[x for k, v in V.RISK.items() for x in (F.lit(k), F.lit(v))])
    return F.lit(0.6) * F.col("confidence") + F.lit(0.4) * F.coalesce(F.element_at(risk, F.col("claim_type")), F.lit(0.5))


def located(field: Column, claim: Column) -> Column:
    """Where a model's claim stands in its field: literally without case, else its most similar sentence from 0.3, else all."""
    at = F.instr(F.lower(field), F.lower(claim))
    best = F.array_max(F.transform(text.sentences(field), lambda s: F.struct(vectors.jaccard(text.token_set(s), text.token_set(claim)).alias("j"), s.alias("s"))))
    return F.when(at > 0, F.substr(field, at, F.length(claim))).when(best["j"] >= 0.3, best["s"]).otherwise(field)
