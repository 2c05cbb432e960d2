"""Scores of labelled runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.vectors import rate

ACCUSING = ("false", "misleading")


def valid_cases(cases: DataFrame, languages: tuple[str, ...] = ("en", "hi", "hinglish")) -> DataFrame:
    """``problems`` of each case: missing keys, unknown values, or a target that is not in the corpus."""
    p = [
        (F.coalesce("id", F.lit("")) == "", "no id"), (F.coalesce("text", F.lit("")) == "", "no text"), (~F.coalesce(F.col("language").isin(*languages), F.lit(False)), "unknown language"),
        (~F.coalesce(F.col("expect.verdict").isin("false", "misleading", "disputed", "unverified", "true"), F.lit(False)), "unknown verdict"), (F.col("expect.check_worthy").isNull(), "check_worthy is no boolean"),
        (F.col("in_corpus").isNull(), "in_corpus is no boolean"), (F.col("expect.retrieves").isNotNull() & ~F.coalesce("in_corpus", F.lit(False)), "a target outside the corpus"),
    ]
    return cases.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in p])))


def selected(cases: DataFrame, language: str | None = None, category: str | None = None, ids: list[str] | None = None, in_corpus: bool | None = None) -> DataFrame:
    for col, value in (("language", language), ("category", category), ("in_corpus", in_corpus)):
        cases = cases.where(F.col(col) == value) if value is not None else cases
    return cases.where(F.col("id").isin(ids)) if ids is not None else cases


def measures() -> list[Column]:
    """Counts of verdicts, check-worthiness and retrieval; what was not measured (null) counts nowhere."""
    v, e = F.col("verdict"), F.col("expected_verdict")
    scored, accusing, expected = v.isNotNull(), v.isin(*ACCUSING), e.isin(*ACCUSING)
    w, x = F.col("check_worthy"), F.col("expected_check_worthy")
    got, target = F.col("retrieved_seed_ids"), F.col("expected_seed_id")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return [
        F.count("*").alias("n"), n(scored, "n_verdicts"), n(v == e, "correct"), n(scored & ~expected & accusing, "false_accusations"), n(expected & scored & ~accusing, "missed"),
        n((v == "unverified") & (e != "unverified"), "abstained"), n(w & x, "tp"), n(w & ~x, "fp"), n(~w & x, "fn"), n(~w & ~x, "tn"),
        n(got.isNotNull() & target.isNotNull(), "targeted"), n(F.array_contains(got, target), "hits"), n(got.isNotNull() & target.isNull(), "untargeted"), n((F.size(got) > 0) & target.isNull(), "strays"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Ratios of the counts; null where nothing was measured."""
    c = F.col
    df = df.withColumns({"accuracy": rate(c("correct"), c("n_verdicts")), "precision": rate(c("tp"), c("tp") + c("fp")), "recall": rate(c("tp"), c("tp") + c("fn")), "hit_rate": rate(c("hits"), c("targeted")), "stray_rate": rate(c("strays"), c("untargeted"))})
    return df.withColumn("f1", rate(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")))


def summary(records: DataFrame) -> DataFrame:
    """Measures overall and by corpus, language and category, in one pass of grouping sets."""
    records.createOrReplaceTempView("__records")
    keys = [F.col("in_corpus"), F.col("language"), F.col("category")]
    out = records.groupingSets([[], [keys[0]], [keys[1]], [keys[2]]], *keys).agg(F.grouping_id().alias("g"), *measures())
    block = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "in_corpus").when(F.col("g") == 5, "language").otherwise("category")
    value = F.when(F.col("g") == 3, F.col("in_corpus").cast("string")).when(F.col("g") == 5, F.col("language")).when(F.col("g") == 6, F.col("category"))
    return with_rates(out.withColumns({"block": block, "value": value})).drop("g", "in_corpus", "language", "category")


def confusion(records: DataFrame) -> DataFrame:
    return records.where("verdict IS NOT NULL").groupBy("expected_verdict", "verdict").agg(F.count("*").alias("n"))


def errors(records: DataFrame) -> DataFrame:
    return records.where("verdict IS NOT NULL AND verdict <> expected_verdict")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs by case: better, worse, changed or same."""
    x, y = a.select("id", F.col("verdict").alias("before"), "expected_verdict"), b.select("id", F.col("verdict").alias("after"))
    was, now = F.col("before").eqNullSafe(F.col("expected_verdict")), F.col("after").eqNullSafe(F.col("expected_verdict"))
    change = F.when(~was & now, "better").when(was & ~now, "worse").when(~F.col("before").eqNullSafe(F.col("after")), "changed").otherwise("same")
    return x.join(y, "id").withColumn("change", change)


def gate(summary_: DataFrame, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """``passed`` and ``reasons`` of the overall block: ratios below, or counts above, what is allowed."""
    low = [F.when(F.coalesce(F.col(k) < v, F.lit(False)), F.lit(f"{k} is below {v}")) for k, v in (least or {}).items()]
    high = [F.when(F.coalesce(F.col(k) > v, F.lit(False)), F.lit(f"{k} is above {v}")) for k, v in (most or {}).items()]
    reasons = F.array_compact(F.array(*low, *high)) if low or high else F.array().cast("array<string>")
    return summary_.where("block = 'overall'").withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def agent_scores(trace: DataFrame) -> DataFrame:
    """Per agent: calls, failures, abstentions, mean calls a case and mean milliseconds. trace: id, agent, ms, error, abstained."""
    out = trace.groupBy("agent").agg(F.count("*").alias("calls"), F.count("error").alias("failures"), F.count_if(F.col("abstained")).alias("abstentions"), F.count_distinct("id").alias("cases"), F.avg("ms").alias("mean_ms"))
    return out.withColumn("calls_per_case", rate(F.col("calls"), F.col("cases")))


def escalation(rounds: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: messages, escalated and settled ones, and what share of the former each is. rounds: before, after, found of
    each message that had a second round; it settled if its label is no longer unverified."""
    settled = (F.col("before") == "unverified") & (F.col("after") != "unverified")
    out = rounds.agg(F.count("*").alias("escalated"), F.count_if(settled).alias("settled"), F.count_if(F.col("before") != F.col("after")).alias("changed"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    out = out.withColumn("messages", F.lit(messages.count()))
    return out.withColumns({"escalation_rate": rate(F.col("escalated"), F.col("messages")), "escalation_yield": rate(F.col("settled"), F.col("escalated"))})


def stage_timings(trace: DataFrame) -> DataFrame:
    """id, stage: total ms, calls and the first error. trace: id, stage, seq, ms, error."""
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq")))
    return trace.groupBy("id", "stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("calls"), first.alias("error"))


def rendered(summary_: DataFrame) -> str:
    """The summary as text; it has one row for each block."""
    show = lambda x: "-" if x is None else f"{x:.1%}"
    lines = [f"{'block':24} {'n':>6} {'accuracy':>9} {'accused':>8} {'missed':>7} {'f1':>7} {'hits':>7}"]
    for r in summary_.orderBy("block", "value").toLocalIterator():
        name = r["block"] if r["value"] is None else f"{r['block']}={r['value']}"
        lines.append(f"{name:24} {r['n']:6} {show(r['accuracy']):>9} {r['false_accusations']:8} {r['missed']:7} {show(r['f1']):>7} {show(r['hit_rate']):>7}")
    return "\n".join(lines)
