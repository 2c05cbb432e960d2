"""Planning on the driver: which steps a batch of messages needs; and the routing of claims to sources."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators import claims as C
from claimloom.operators import graph

MOST_STEPS, MOST_ROUNDS, MOST_CLAIMS, MOST_ESCALATED = 16, 2, 8, 4
AGENTS = ("claims", "evidence", "media", "verification", "explanation")


@dataclass
class Step:
    agent: str
    why: str = ""
    options: dict = field(default_factory=dict)


@dataclass
class Trace:
    """What ran, for the trace table."""

    rows: list[dict] = field(default_factory=list)

    def add(self, agent: str, ms: float, error: str | None = None, abstained: bool = False) -> None:
        self.rows.append({"seq": len(self.rows), "agent": agent, "ms": ms, "error": error, "abstained": abstained})

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], "seq int, agent string, ms double, error string, abstained boolean")


def plan(observed: dict) -> list[Step]:
    """Steps by rule: no evidence or media without text or pictures to look at."""
    steps = [Step("claims", "find what can be checked")]
    if observed.get("has_text") or observed.get("has_images"):
        steps.append(Step("evidence", "look for sources", {"hold_back": ["web"]}))
    if observed.get("has_images"):
        steps.append(Step("media", "look at the pictures"))
    return [*steps, Step("verification", "weigh the sides"), Step("explanation", "say why")]


def parsed_plan(reply: str, observed: dict) -> list[Step]:
    """A model's plan, the first JSON list or object in its reply; anything invalid falls back to the rules."""
    found = re.search(r"\[.*\]|\{.*\}", reply, re.S)
    try:
        data = json.loads(found.group()) if found else None
        steps = data.get("steps") if isinstance(data, dict) else data
        out = [Step(s["agent"], str(s.get("why", ""))) for s in steps]
    except (ValueError, TypeError, KeyError, AttributeError):
        return plan(observed)
    names = [s.agent for s in out]
    ok = out and len(out) <= MOST_STEPS and names[0] == "claims" and "verification" in names and all(n in AGENTS for n in names)
    return out if ok else plan(observed)


def run(steps: list[Step], tools: dict[str, Callable[[dict], dict]], state: dict, escalate: Callable[[dict], bool] | None = None) -> tuple[dict, Trace]:
    """Runs steps in order over ``state`` (frames by name); a failing tool is noted and the rest goes on.

    Evidence and media are skipped when no claim is worth checking. When the queue is empty, ``escalate`` may ask for
    another round of evidence and verification with what was held back, at most ``MOST_ROUNDS`` rounds in all.
    """
    import time

    trace, queue, done, rounds = Trace(), list(steps), 0, 1
    while queue and done < MOST_STEPS:
        step, done = queue.pop(0), done + 1
        if step.agent in ("evidence", "media") and state.get("n_worthy") == 0:
            trace.add(step.agent, 0.0, None, True)
            continue
        began, error = time.time(), None
        try:
            state |= tools[step.agent](state | step.options)
        except Exception as e:  # noted in the trace
            error = f"{type(e).__name__}: {e}"[:300]
        trace.add(step.agent, (time.time() - began) * 1000, error)
        if not queue and escalate and rounds < MOST_ROUNDS and escalate(state):
            rounds += 1
            queue = [Step("evidence", "with what was held back", {"hold_back": []}), Step("verification", "again"), Step("explanation", "again")]
    return state, trace


def prioritised(claims: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """Check-worthy claims with ``priority``; beyond ``most`` a message they are ``deferred``."""
    df = claims.where("check_worthy").withColumn("priority", C.priority())
    order = Window.partitionBy("packet_id").orderBy(F.desc("priority"), "claim_id")
    return df.withColumn("rank", F.row_number().over(order)).withColumn("deferred", F.col("rank") > most)


def escalated(claims: DataFrame, stances: DataFrame, tried: DataFrame, most: int = MOST_ESCALATED) -> DataFrame:
    """Open claims of a message that the held-back source has not been asked about, at most ``most``."""
    rest = graph.open_claims(claims, stances).join(tried.select("claim_id"), "claim_id", "left_anti")
    order = Window.partitionBy("packet_id").orderBy(F.desc("confidence"), "claim_id")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search_confidence(kept: F.Column, decisive: F.Column) -> F.Column:
    return F.when(decisive > 0, F.lit(0.9)).otherwise(F.least(F.lit(0.75), F.lit(0.3) + F.lit(0.1) * kept))


def attached(known: F.Column, new: F.Column) -> F.Column:
    """Evidence ids with further ones that are not known yet."""
    return F.array_union(known, new)


def unavailable(tools: list[str], usable: list[str]) -> list[str]:
    return [t for t in tools if t not in usable]
