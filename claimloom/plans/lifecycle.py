"""The whole check of messages in stages: claims, evidence of many sources, stances, verdicts."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.functions import vocab as V
from claimloom.operators import claims as C
from claimloom.operators import evidence as EV
from claimloom.operators import agents, scoring, stance, verdict
from claimloom.sources import fanout
from claimloom.sources.folders import checkpointing

ITEM = "item_id string, url string, title string, snippet string, publisher string, domain string, published_date string, rating_raw string, score double, demo boolean"


class Stages:
    """Stage tables of a run, each checkpointed once, with what was counted while it was made."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []
        checkpointing(spark)

    def settled(self, name: str, df: DataFrame, **counts: Column) -> DataFrame:
        """The table, written to the shared folder; its number of rows and ``counts`` come from the run that wrote it."""
        seen, began = Observation(f"{name}-{uuid.uuid4().hex}"), time.perf_counter()
        out = df.observe(seen, F.count("*").alias("rows"), *[c.cast("long").alias(k) for k, c in counts.items()]).checkpoint()
        got = seen.get
        self.rows.append((name, round(1000 * (time.perf_counter() - began), 1), got["rows"], {k: got[k] or 0 for k in counts}))
        return out

    def table(self) -> DataFrame:
        """stage, ms, rows, counts."""
        return self.spark.createDataFrame(self.rows, "stage string, ms double, rows long, counts map<string,long>")


@dataclass
class Sources:
    """Where evidence comes from: callables on batches of queries, plans on tables of claims and queries, and how to ask."""

    services: dict[str, fanout.Service] = field(default_factory=dict)
    tables: dict[str, fanout.Table] = field(default_factory=dict)
    how: dict = field(default_factory=dict)


def seed_index(corpus: DataFrame, k: int = 3, floor: float = 0.3) -> fanout.Table:
    """A source: a corpus of known fact-checks (item_id, text, and any of url, domain, publisher, rating_raw, summary, published_date, demo), by words."""
    has = lambda c, kind="string": F.col(c).cast(kind) if c in corpus.columns else F.lit(None).cast(kind)

    def find(claims: DataFrame, queries: DataFrame) -> DataFrame:
        found = EV.lexical_candidates(claims.select("claim_id", "text"), corpus.select("item_id", "text"), floor, k).select("claim_id", "item_id", F.col("overlap").alias("score"))
        items = corpus.select("item_id", F.col("text").alias("title"), has("summary").alias("snippet"), *[has(c) for c in ("url", "domain", "publisher", "rating_raw", "published_date")], has("demo", "boolean"))
        names = [c.split()[0] for c in ITEM.split(", ")]
        items = items.toDF("item_id", "title", "snippet", "url", "domain", "publisher", "rating_raw", "published_date", "demo")
        return found.join(items, "item_id").select("claim_id", *names)

    return find


def claim_queries(claims: DataFrame, most: int = V.MOST_QUERIES) -> DataFrame:
    """Queries of claims as ``claims.extract`` makes them: entities that name or count something, and dates, in order."""
    texts = lambda labels: F.transform(F.filter("entities", lambda e: e["label"].isin(*labels)), lambda e: e["text"])
    dates = F.transform("times", lambda t: F.coalesce(t["normalized"], t["text"]))
    return EV.build_queries(claims.select("claim_id", F.col("sentence").alias("text"), "claim_type", "language", texts(V.KEYWORD_LABELS).alias("terms"), dates.alias("dates")), most)


@dataclass
class Checked:
    """Tables of a run; those of stages that were not asked for are None."""

    claims: DataFrame  # worthy and rejected sentences
    evidence: DataFrame | None = None
    failures: DataFrame | None = None  # source, batch, claim_ids, tries, error
    stances: DataFrame | None = None
    verdicts: DataFrame | None = None  # of claims
    packets: DataFrame | None = None  # of messages
    stages: DataFrame | None = None


def run(packets: DataFrame, today: dt.date, sources: Sources | None = None, tiers: DataFrame | None = None, lexicon: text.Lexicon | None = None, model: tuple[str, Callable[[], scoring.Scorer]] | None = None, judge: bool = True, plain: bool = False) -> Checked:
    """Messages through the stages: claims; with ``sources`` evidence; with ``judge`` stances and verdicts too.

    Messages of one id are one. ``model``: name and loader of a pair scorer; without one only publishers' ratings take
    sides. A source that fails leaves its rows in ``failures`` and the others' evidence whole. Each stage is
    checkpointed once, and counted by the run that writes it.
    """
    stages = Stages(packets.sparkSession)
    packets = packets.dropDuplicates(["packet_id"])
    rows = stages.settled("claims", C.extract(packets, today, lexicon, plain=plain), worthy=F.count_if("check_worthy"))
    out = Checked(rows)
    if sources is not None:
        worthy = rows.where("check_worthy").dropDuplicates(["claim_id"])
        asked = worthy.select("claim_id", F.col("sentence").alias("text"))
        queries = claim_queries(worthy)
        found, out.failures = fanout.collect(asked, queries, sources.services, sources.tables, **sources.how)
        tiers = tiers if tiers is not None else packets.sparkSession.createDataFrame([], "entry string, tier string")
        kept = EV.normalised(EV.from_sources(found), asked, tiers, lexicon=lexicon)
        out.evidence = stages.settled("evidence", kept, decisive=F.count_if("decisive"), claims=F.approx_count_distinct("claim_id"))
        if judge:
            judged = stance.judged(out.evidence, asked, model[1], model[0]) if model else stance.decided(out.evidence, None)
            out.stances = stages.settled("stances", judged, sided=F.count_if(F.col("stance") != "neutral"))
            items = out.stances.select("claim_id", "id", "stance", F.col("stance_score").alias("score"), F.col("source_weight").alias("weight"), "decisive", "demo", "rating")
            claims = verdict.for_claims(worthy.select("packet_id", "claim_id", F.col("sentence").alias("text")), items)
            out.verdicts = stages.settled("verdicts", claims, verified=F.count_if(F.col("label") != "unverified"))
            out.packets = packets.select("packet_id").join(verdict.roll_up(out.verdicts), "packet_id", "left").fillna({"label": "unverified", "confidence": 0.2, "n_claims": 0, "summary": "no claim to check"})
    out.stages = stages.table()
    return out


def check(packets: DataFrame, corpus: DataFrame, tiers: DataFrame, today: dt.date, lexicon: text.Lexicon | None = None) -> tuple[DataFrame, DataFrame]:
    """(claim verdicts, packet verdicts) of messages against a corpus of fact-checks; messages without claims are unverified."""
    done = run(packets, today, Sources(tables={"seed_index": seed_index(corpus)}), tiers, lexicon)
    if done.failures.count():
        raise RuntimeError(f"the corpus could not be searched: {done.failures.first()['error']}")
    return done.verdicts, done.packets


def second_round(done: Checked, reserve: Sources, tiers: DataFrame | None = None, lexicon: text.Lexicon | None = None, model: tuple[str, Callable[[], scoring.Scorer]] | None = None, most_claims: int = agents.MOST_ESCALATED, most_queries: int = 5) -> tuple[Checked, DataFrame]:
    """(the run with what sources held back found for its open claims, escalation): only claims that nothing supports or refutes are asked about.

    Of a message at most ``most_claims`` are asked, the surest first, with up to ``most_queries`` queries each. What is
    new is judged alone and added; evidence that was known stays as it was judged. escalation: packet_id, before, after,
    claims, found: one row for each message that had such claims.
    """
    stages = Stages(done.claims.sparkSession)
    worthy = done.claims.where("check_worthy").dropDuplicates(["claim_id"])
    open_ = agents.escalated(worthy, done.stances, worthy.limit(0), most_claims)
    open_ = stages.settled("open claims", worthy.join(open_.select("claim_id"), "claim_id", "left_semi"), packets=F.approx_count_distinct("packet_id"))
    asked = open_.select("claim_id", F.col("sentence").alias("text"))
    found, failures = fanout.collect(asked, claim_queries(open_, most_queries), reserve.services, reserve.tables, **reserve.how)
    tiers = tiers if tiers is not None else done.claims.sparkSession.createDataFrame([], "entry string, tier string")
    kept = EV.normalised(EV.from_sources(found), asked, tiers, lexicon=lexicon).join(done.evidence.select("claim_id", "id"), ["claim_id", "id"], "left_anti")
    new = stages.settled("second evidence", kept, decisive=F.count_if("decisive"))
    judged = stages.settled("second stances", stance.judged(new, asked, model[1], model[0]) if model else stance.decided(new, None), sided=F.count_if(F.col("stance") != "neutral"))
    out = Checked(done.claims, done.evidence.unionByName(new, allowMissingColumns=True), done.failures.unionByName(failures), done.stances.unionByName(judged, allowMissingColumns=True))
    items = out.stances.select("claim_id", "id", "stance", F.col("stance_score").alias("score"), F.col("source_weight").alias("weight"), "decisive", "demo", "rating")
    out.verdicts = stages.settled("second verdicts", verdict.for_claims(worthy.select("packet_id", "claim_id", F.col("sentence").alias("text")), items), verified=F.count_if(F.col("label") != "unverified"))
    out.packets = done.packets.select("packet_id").join(verdict.roll_up(out.verdicts), "packet_id", "left").fillna({"label": "unverified", "confidence": 0.2, "n_claims": 0, "summary": "no claim to check"})
    out.stages = done.stages.unionByName(stages.table())
    tried = open_.groupBy("packet_id").agg(F.count("*").alias("claims"))
    got = new.join(open_.select("claim_id", "packet_id"), "claim_id").groupBy("packet_id").agg(F.count("*").alias("found"))
    labels = done.packets.select("packet_id", F.col("label").alias("before")).join(out.packets.select("packet_id", F.col("label").alias("after")), "packet_id")
    return out, tried.join(labels, "packet_id").join(got, "packet_id", "left").fillna(0, ["found"]).select("packet_id", "before", "after", "claims", "found")
