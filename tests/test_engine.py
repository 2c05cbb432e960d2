"""Sources asked apart, pairs scored in batches, a language model's claims, stages and evaluation runs."""

import datetime as dt
import json
import math
from collections import Counter

import pytest
from claimloom.functions import text
from claimloom.operators import claims as C
from claimloom.operators import evidence as EV
from claimloom.operators import evaluation, image_index, model_claims, scoring, stance
from claimloom.plans import evaluate, lifecycle
from claimloom.sources import fanout, readers
from pyspark.sql import functions as F

DAY = dt.date(2024, 3, 10)
QUERY = "claim_id string, rank int, text string"


def asked(spark, n=40):
    return spark.createDataFrame([(f"c{k // 2}", k % 2, f"query {k}") for k in range(n)], QUERY)


def echo(batch):
    return [{"claim_id": q["claim_id"], "url": f"https://x.org/{q['text']}", "title": q["text"], "score": 0.5} for q in batch]


def broken(batch):
    if any(q["claim_id"] in ("c3", "c11") for q in batch):
        raise ConnectionError("down")
    return echo(batch)


def hanging(batch):
    import time

    if any(q["claim_id"] == "c3" for q in batch):
        time.sleep(3)
    return echo(batch)


def wrong_kind(batch):
    return [{"claim_id": q["claim_id"], "score": "much"} for q in batch]


def test_a_source_that_fails_costs_its_batch_only(spark):
    queries = asked(spark).repartition(7)
    found, failed = fanout.collect(queries, queries, {"web": echo, "factcheck": broken, "odd": wrong_kind}, {"seed_index": lambda c, q: q.select("claim_id", F.col("text").alias("title")), "gone": lambda c, q: q.select("no_such_column"), "late": lambda c, q: q.select("claim_id", F.raise_error(F.lit("boom")).alias("title"))}, batch=8, tries=2)
    n = {r["source"]: r["n"] for r in found.groupBy("source").agg(F.count("*").alias("n")).collect()}
    lost = {r["source"]: r for r in failed.groupBy("source").agg(F.flatten(F.collect_list("claim_ids")).alias("ids"), F.max("tries").alias("tries"), F.min("error").alias("error")).collect()}
    assert n["web"] == n["seed_index"] == 40 and "odd" not in n and "gone" not in n and "late" not in n
    assert set(lost) == {"factcheck", "odd", "gone", "late"} and all(r["tries"] == 2 or s == "odd" for s, r in lost.items())
    assert {"c3", "c11"} <= set(lost["factcheck"]["ids"]) and "ConnectionError: down" in lost["factcheck"]["error"] and "boom" in lost["late"]["error"]
    assert n["factcheck"] == 40 - 2 * len(lost["factcheck"]["ids"]) and len(set(lost["odd"]["ids"])) == 20
    more, still = fanout.again(failed, queries, {"factcheck": echo}, batch=8)
    assert still.isEmpty() and {r["claim_id"] for r in more.collect()} == set(lost["factcheck"]["ids"])
    report = {r["source"]: tuple(r)[1:] for r in fanout.report(found, failed).collect()}
    assert report["web"] == (40, 20, 0, 0) and report["factcheck"][3] == len(lost["factcheck"]["ids"]) and report["gone"] == (0, 0, 1, 0)


def test_calls_have_a_time_limit_and_retries(spark, tmp_path):
    queries = asked(spark, 12)
    found, failed = fanout.collect(queries, queries, {"web": hanging}, batch=4, tries=1, limit_s=1.0)
    assert {r["error"] for r in failed.collect()} == {"no answer in 1.0 s"} and found.count() == 12 - 2 * sum(len(r["claim_ids"]) for r in failed.collect())
    mark = str(tmp_path / "mark")

    def second_time(batch):
        import os

        path = f"{mark}-{batch[0]['claim_id']}"
        if not os.path.exists(path):
            open(path, "w").close()
            raise TimeoutError
        return echo(batch)

    found, failed = fanout.collect(queries, queries, {"web": second_time}, batch=4, tries=2)
    assert found.count() == 12 and failed.isEmpty()
    none = queries.limit(0)
    found, failed = fanout.collect(none, none, {"web": echo})
    assert found.isEmpty() and failed.isEmpty()


def test_each_batch_is_one_call_with_all_of_a_claim(spark):
    got = fanout.ask(asked(spark), {"web": echo}, batch=8).collect()
    assert sum(len(r["found"]) for r in got) == 40 and len([c for r in got for c in r["claim_ids"]]) == 20 and len(got) == len({r["batch"] for r in got}) > 1


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id long, premise string, hypothesis string")


def test_pairs_are_packed_scored_once_and_put_back(spark, tmp_path):
    calls = str(tmp_path)
    rows = [(k, f"premise {'x ' * (k % 17)}{k % 60}", "premise of x") for k in range(300)] + [(900, None, "h"), (901, " ", "h"), (902, "p", "")]

    def load():
        inner = scoring.word_overlap()
        import os
        import uuid

        open(os.path.join(calls, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def score(p, h):
            assert len(p) <= 8
            open(os.path.join(calls, f"call-{uuid.uuid4().hex}"), "w").write(json.dumps([len(x) for x in p]))
            return inner(p, h)

        return score

    got = scoring.votes(scoring.score_pairs(pairs(spark, rows).repartition(5), load, f"test-{calls}", ["id"])).collect()
    assert len(got) == 303
    plain = scoring.word_overlap()
    for r in got:
        if r["id"] >= 900:
            assert r["scores"] is None and r["error"] is None and r["stance"] is None
        else:
            want = plain([r["premise"]], [r["hypothesis"]])[0]
            assert [r["scores"][x] for x in scoring.LABELS] == list(want) and r["score"] == round(max(want), 4) and r["stance"] == scoring.LABELS[want.index(max(want))]
    files = [p.name for p in tmp_path.iterdir()]
    sizes = [json.loads((tmp_path / f).read_text()) for f in files if f.startswith("call")]
    assert sum(map(len, sizes)) == len({(p, h) for _, p, h in rows if p and p.strip() and h}) and all(a == sorted(a, reverse=True) for a in sizes)
    loads = Counter(f.split("-")[1] for f in files if f.startswith("load"))
    assert max(loads.values()) == 1


def test_a_pair_that_fails_costs_itself_only(spark):
    def load():
        def score(p, h):
            if any("bad" in x for x in p):
                raise ValueError("bad input")
            if any("nan" in x for x in p):
                return [(float("nan"), 0.0, 0.0)] * len(p)
            return [(0.1, 0.2, 0.7)] * (len(p) - 1 if any("short" in x for x in p) else len(p))

        return score

    rows = [(k, f"text {k}", "h") for k in range(30)] + [(100, "bad", "h"), (101, "nan", "h"), (102, "short", "h")]
    got = {r["id"]: r for r in scoring.score_pairs(pairs(spark, rows).repartition(1), load, "failing", ["id"]).collect()}
    assert all(got[k]["scores"] == {"supports": 0.1, "neutral": 0.2, "refutes": 0.7} and got[k]["error"] is None for k in range(30))
    assert got[100]["error"] == "ValueError: bad input" and "finite" in got[101]["error"] and "short" in got[102]["error"] and all(got[k]["scores"] is None for k in (100, 101, 102))

    def absent():
        raise ImportError("no model")

    assert {r["error"] for r in scoring.score_pairs(pairs(spark, rows), absent, "absent", ["id"]).collect()} == {"ImportError: no model"}
    assert scoring.score_pairs(pairs(spark, []), absent, "absent", ["id"]).isEmpty()


EVIDENCE = "claim_id string, id string, title string, snippet string, text string, rating string, rating_raw string, about string"


def test_judged_by_gate_passages_model_and_rating(spark):
    claims = spark.createDataFrame([("c", "Lemon water cures every cancer patient"), ("e", " ")], "claim_id string, text string")
    rows = [
        ("c", "same", None, None, "Lemon water cures every cancer patient. Filler words stand alone here. More filler text follows now.", None, None, None), ("c", "far", None, None, "The train was late again today. Nobody knew why.", None, None, None), ("c", "blank", None, None, " ", None, None, None),
        ("c", "rated", "Lemon water cures every cancer patient", None, None, "false", "False", "about"), ("c", "other", "Lemon water cures every cancer patient", None, None, "false", "False", "not_about"), ("e", "x", None, None, "Some text of an item.", None, None, None), ("z", "y", None, None, "Some text of an item.", None, None, None),
        ("c", "mixed", "Lemon water cures", None, "Lemon water cures every cancer patient", "misleading", "Half true", "about"),
    ]
    got = {r["id"]: r for r in stance.judged(spark.createDataFrame(rows, EVIDENCE), claims).collect()}
    assert (got["same"]["method"], got["same"]["stance"], got["same"]["note"]) == ("nli", "neutral", None) or got["same"]["stance"] == "supports"
    assert (got["far"]["method"], got["far"]["stance"], got["far"]["note"]) == ("off_topic", "neutral", "no passage cleared the relevance cutoff")
    assert (got["blank"]["method"], got["blank"]["note"]) == ("unavailable", "no evidence text") and got["x"]["note"] == got["y"]["note"] == "claim has no text"
    r = got["rated"]
    assert (r["method"], r["stance"], r["stance_score"], r["misleading"], r["best_passage"]) == ("rating", "refutes", 1.0, True, rows[3][2])
    assert (got["other"]["method"], got["other"]["stance"], got["other"]["stance_score"], got["other"]["best_passage"]) == ("not_about", "neutral", 0.0, None)
    assert (got["mixed"]["stance"], got["mixed"]["stance_score"], got["mixed"]["misleading"]) == ("neutral", 0.5, False)

    def fails():
        def score(p, h):
            raise RuntimeError("no memory")

        return score

    got = {r["id"]: r for r in stance.judged(spark.createDataFrame(rows, EVIDENCE), claims, fails, "fails").collect()}
    assert (got["same"]["method"], got["same"]["stance"], got["same"]["note"]) == ("unavailable", "neutral", "RuntimeError: no memory") and got["rated"]["stance"] == "refutes" and got["far"]["method"] == "off_topic"


def test_strongest_side_needs_half_and_neutral_takes_all(spark):
    rows = [("a", "supports", 0.49, 1, 0.3), ("a", "neutral", 0.4, 2, 0.4), ("b", "supports", 0.6, 1, 0.1), ("b", "refutes", 0.6, 2, 0.2), ("d", "refutes", 0.7, 1, 0.1), ("d", "refutes", 0.7, 0, 0.1)]
    df = spark.createDataFrame([(*r, 0.5 if r[3] == 1 else 0.9) for r in rows], "k string, stance string, score double, pos long, neutral double, sim double")
    got = {r["k"]: (r["stance"], r["score"], r["pos"]) for r in stance.strongest(df, ["k"], order="sim", neutral="neutral").collect()}
    assert got == {"a": ("neutral", 0.4, 2), "b": ("refutes", 0.6, 2), "d": ("refutes", 0.7, 0)}


def answers(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "a string")


def test_answers_of_a_language_model(spark):
    item = {"text": " Tax of 5% from May ", "claim_type": "policy", "confidence": 0.9, "attributed_to": "Rao", "time": "May", "entities": [{"text": "Rao", "label": "PERSON"}, {"text": "x", "label": "CAT"}, {"label": "ORG"}, "no", None]}
    whole = json.dumps({"claims": [item]})
    odd = [json.dumps({"claims": [c]}) for c in ({"text": "t", "confidence": 7}, {"text": "t", "confidence": -1}, {"text": "t", "confidence": "0.25"}, {"text": "t", "confidence": "high"}, {"text": "t", "confidence": None}, {"text": "t", "confidence": True}, {"text": "t", "confidence": [1]}, {"text": "t", "confidence": "NaN"}, {"text": "t"})]
    none = [None, "", "no json", whole[:-5], "[]", "7", "null", '{"claims": null}', '{"claims": {}}', '{"claims": []}', '{"claims": [7, null, "x", {}, {"text": ""}, {"text": " "}, {"text": 7}, {"text": null}]}', '{"other": 1}']
    got = [r["x"] for r in answers(spark, [whole, *odd, *none]).select(model_claims.claims_of(F.col("a")).alias("x")).collect()]
    c = got[0][0]
    assert (c["text"], c["claim_type"], c["confidence"], c["attributed_to"], c["time"], [tuple(e) for e in c["entities"]]) == ("Tax of 5% from May", "policy", 0.9, "Rao", "May", [("Rao", "PERSON")])
    assert [x[0]["confidence"] for x in got[1:10]] == [1.0, 0.0, 0.25, 0.5, 0.5, 1.0, 0.5, 1.0, 0.5] and all(x[0]["claim_type"] == "generic" and x[0]["attributed_to"] is None and x[0]["entities"] == [] for x in got[1:10])
    assert all(x == [] for x in got[10:])


def test_a_models_claims_of_messages(spark):
    said = "Rao paid Rs 500 to the bank. It rained a lot. The tax of 5% begins in May 2024."
    packets = readers.text_packets(spark.createDataFrame([(said,), ("No answer here today.",)], "text string"))
    item = lambda t, c, **more: {"text": t, "confidence": c, **more}
    answer = json.dumps({"claims": [item("rao paid rs 500 to the bank", 0.9, claim_type="money", entities=[{"text": "RAO", "label": "PERSON"}, {"text": "500", "label": "NUMBER"}, {"text": "gone", "label": "ORG"}], attributed_to="Rao"), item("Rao paid Rs 500 to the bank.", 0.95), item("a tax of 5% begins", 0.2)]})
    a = packets.withColumn("pos", F.lit(0)).select("packet_id", "pos", F.when(F.col("text").startswith("Rao"), F.lit(answer)).alias("answer"))
    got, dropped = model_claims.extract(packets, a, DAY)
    (r,) = got.collect()
    assert (r["sentence"], r["claim_type"], r["confidence"], r["attributed_to"], r["start"], r["end"], r["numbers"]) == ("rao paid rs 500 to the bank", "money", 0.95, "Rao", 0, 27, ["INR 500"])
    assert [(e["text"], e["label"]) for e in r["entities"]] == [("rao", "PERSON"), ("rs 500", "MONEY")]
    assert sorted((d["text"], d["reason"]) for d in dropped.collect()) == [("It rained a lot.", "llm_not_claim"), ("No answer here today.", "llm_not_claim"), ("a tax of 5% begins", "llm_low_confidence")]


def test_a_models_type_and_score(spark):
    rows = [("The minister said the new scheme costs 500 crore in Delhi", 0.9, {"money": 0.5, "health": 0.45}), ("The minister said the new scheme costs 500 crore in Delhi", 0.9, {"money": 0.6, "health": 0.3}), ("This vaccine cures cancer in 5 days", 0.1, {"money": 0.9}), ("Hello!", 1.0, {"money": 0.9}), ("The minister said the new scheme costs 500 crore in Delhi", None, None), ("The minister said the new scheme costs 500 crore in Delhi", 0.9, {"unheard": 0.9})]
    df = C.with_plain_entities(C.with_features(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, sentence string, m double, t map<string,double>")))
    own = {r["k"]: r for r in C.scored(df).collect()}
    got = {r["k"]: r for r in C.scored(df, F.col("m"), F.col("t")).collect()}
    assert [got[k]["claim_type"] for k in range(6)] == [own[0]["claim_type"], "money", "health", own[3]["claim_type"], own[4]["claim_type"], own[5]["claim_type"]] and own[0]["claim_type"] != "money"
    assert got[0]["confidence"] == round((own[0]["confidence"] + 0.9) / 2, 3) and got[3]["confidence"] == 0.0 and got[4]["confidence"] == own[4]["confidence"]
    assert got[2]["drop_reason"] in (None, "model_not_claim")


def test_rare_words_find_all_pairs(spark):
    """The prefix of rare words loses no pair that counting all words finds."""
    import random

    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    claims = [(k, " ".join(word() for _ in range(rng.randint(0, 14)))) for k in range(60)] + [(100, None), (101, "unseen words only"), (102, "w1 w1")]
    corpus = [(k, " ".join(word() for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(100, None)]
    a, b = spark.createDataFrame(claims, "claim_id int, text string"), spark.createDataFrame(corpus, "item_id int, text string")
    sets = lambda rows: {k: {w for w in (t or "").split() if len(w) > 1 and w not in text.V.OVERLAP_STOP.split()} for k, t in rows}
    x, y = sets(claims), sets(corpus)
    for floor in (0.2, 0.3, 0.45, 0.5, 1.0):
        want = {(i, j, len(w), len(w & v)) for i, w in x.items() for j, v in y.items() if w and len(w & v) and len(w & v) / len(w) >= floor}
        assert {(r["claim_id"], r["item_id"], r["terms"], r["shared"]) for r in EV.lexical_candidates(a, b, floor).collect()} == want


CORPUS = "item_id string, text string, rating_raw string, url string, publisher string"
RUMOUR = "The government said hot water cures cancer in 5 days"


def setting(spark):
    corpus = spark.createDataFrame([("s1", RUMOUR, "False", "https://check.example.org/1", "Checkers"), ("s2", "Reserve Bank banned 500 rupee notes today in Delhi", "Misleading", "https://check.example.org/2", "Checkers")], CORPUS)
    tiers = spark.createDataFrame([("check.example.org", "factchecker")], "entry string, tier string")
    expect = "expect struct<verdict:string,check_worthy:boolean,retrieves:string>"
    cases = [
        ("a", RUMOUR + ".", "en", "health", ("false", True, "s1"), True), ("b", RUMOUR + ".", "en", "health", ("false", True, "s1"), True), ("c", "Hello there friend!", "en", "chat", ("unverified", False, None), False),
        ("d", "The ministry announced a free laptop scheme for 2024 in Goa.", "en", "govt", ("unverified", True, None), False), ("e", "", "en", "chat", ("unverified", False, None), False), ("f", RUMOUR, "xx", "health", ("false", True, "s1"), True),
    ]
    return corpus, tiers, spark.createDataFrame(cases, f"id string, text string, language string, category string, {expect}, in_corpus boolean")


def test_modes_report_what_they_measure(spark):
    corpus, tiers, cases = setting(spark)
    records, done = evaluate.run(cases, DAY, lifecycle.Sources(tables={"seed_index": lifecycle.seed_index(corpus)}), tiers)
    got = {(r["id"], r["mode"]): r for r in records.collect()}
    assert len(got) == 18 and all(got[i, m]["verdict"] is None for i in "abcd" for m in ("claims", "retrieval")) and all(got[i, "claims"]["retrieved_seed_ids"] is None for i in "abcd")
    for i in "ab":
        assert (got[i, "full"]["verdict"], got[i, "full"]["confidence"], got[i, "full"]["retrieved_seed_ids"], got[i, "full"]["check_worthy"]) == ("false", 0.9, ["s1"], True) and got[i, "retrieval"]["retrieved_seed_ids"] == ["s1"]
    assert (got["c", "full"]["verdict"], got["c", "full"]["check_worthy"], got["c", "full"]["n_claims"], got["c", "retrieval"]["retrieved_seed_ids"]) == ("unverified", False, 0, []) and got["d", "full"]["verdict"] == "unverified"
    for i, why in (("e", "no text"), ("f", "unknown language")):
        assert all(got[i, m]["verdict"] is None and got[i, m]["check_worthy"] is None and got[i, m]["stage_errors"] == {"runner": why} for m in evaluate.MODES)
    s = {r["value"]: r for r in evaluation.summary(records.where("mode = 'full'")).where("block IN ('overall', 'category')").collect()}
    assert (s[None]["n"], s[None]["n_verdicts"], s[None]["correct"], s[None]["false_accusations"], s[None]["hits"], s[None]["targeted"]) == (6, 4, 4, 0, 2, 2)
    stages = {r["stage"]: r for r in done.stages.collect()}
    assert list(stages) == ["claims", "evidence", "stances", "verdicts"] and stages["claims"]["counts"]["worthy"] == 2 and stages["evidence"]["counts"]["decisive"] == 1 and stages["verdicts"]["rows"] == 2
    assert done.claims.where("check_worthy").count() == stages["claims"]["counts"]["worthy"] and done.evidence.count() == stages["evidence"]["rows"]


def test_modes_make_only_their_stages(spark):
    corpus, tiers, cases = setting(spark)
    sources = lifecycle.Sources(tables={"seed_index": lifecycle.seed_index(corpus)})
    for modes, want in ((("claims",), ["claims"]), (("retrieval",), ["claims", "evidence"])):
        records, done = evaluate.run(cases, DAY, sources, tiers, modes)
        assert [r["stage"] for r in done.stages.collect()] == want and records.count() == 6
    with pytest.raises(ValueError, match="unknown modes"):
        evaluate.run(cases, DAY, sources, tiers, ("fast",))
    records, _ = evaluate.run(cases.limit(0), DAY, sources, tiers)
    assert records.isEmpty()


def test_failures_stand_in_the_records(spark):
    """A source that failed does not look like one that found nothing, and the others' evidence is whole."""
    corpus, tiers, cases = setting(spark)

    def down(batch):
        if any("laptop" in q["text"] for q in batch):
            raise ConnectionError("down")
        return []

    def plan_fails(claims, queries):
        raise RuntimeError("no such index")

    sources = lifecycle.Sources({"web": down, "factcheck": echo}, {"seed_index": lifecycle.seed_index(corpus)}, {"batch": 1, "tries": 1})
    records, done = evaluate.run(cases, DAY, sources, tiers)
    got = {(r["id"], r["mode"]): r for r in records.collect()}
    assert "web: ConnectionError: down" in got["d", "full"]["stage_errors"]["evidence"] and "evidence" in got["d", "retrieval"]["stage_errors"] and got["d", "claims"]["stage_errors"] == {} and got["c", "full"]["stage_errors"] == {}
    assert got["a", "full"]["verdict"] == "false" and {r["source_type"] for r in done.evidence.collect()} == {"seed_index", "factcheck"}
    sources = lifecycle.Sources(tables={"seed_index": plan_fails})
    records, _ = evaluate.run(cases, DAY, sources, tiers)
    got = {(r["id"], r["mode"]): r for r in records.collect()}
    assert "seed_index: RuntimeError: no such index" in got["a", "full"]["stage_errors"]["evidence"] and got["a", "full"]["verdict"] == "unverified" and got["c", "full"]["stage_errors"] == {}
    with pytest.raises(RuntimeError, match="could not be searched"):
        lifecycle.check(readers.text_packets(cases), corpus.drop("text"), tiers, DAY)


def test_a_model_in_the_run(spark):
    corpus, tiers, cases = setting(spark)
    unrated = lambda batch: [{"claim_id": q["claim_id"], "url": f"https://n.org/{q['claim_id']}", "title": q["text"], "text": q["text"]} for q in batch]
    sources = lifecycle.Sources({"web": unrated}, {"seed_index": lifecycle.seed_index(corpus)})
    done = evaluate.run(cases, DAY, sources, tiers, model=("words", scoring.word_overlap))[1]
    got = {r["source_type"]: r for r in done.stances.collect()}
    assert got["seed_index"]["method"] == "rating" and got["web"]["method"] == "nli" and math.isclose(got["web"]["stance_score"], 1.0, abs_tol=0.6)


def clustered(n=240, width=8, seed=3):
    """Vectors in eight tight groups."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return [(k, (np.eye(width)[k % width] + 0.05 * rng.normal(size=width)).tolist()) for k in range(n)]


def nearest(entries, asked, floor, k):
    import numpy as np

    out = set()
    for i, v in asked:
        near = sorted((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in entries if j != i)
        out |= {(i, j, r) for r, (s, j) in enumerate([x for x in near if -x[0] >= floor][:k], 1)}
    return out


def test_stored_index_grows_and_reads_only_near_cells(spark, tmp_path):
    at, rows = str(tmp_path / "index"), clustered()
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0] * 3), (1005, [1e200] * 8)]
    frame = lambda part: spark.createDataFrame(part, "id int, embedding array<double>").withColumn("extra", F.lit("x"))
    assert image_index.build(frame(rows[:100] + odd), at, cells=8) == 1 and image_index.append(frame(rows[100:200]), at) == 2
    asked = [rows[k] for k in (0, 8, 120)] + [(2000, rows[3][1])]
    queries = spark.createDataFrame([*asked, (2001, None), (2002, [1.0] * 3), (2003, [0.0] * 8)], "id int, v array<double>")
    got = image_index.search(queries, at, 0.95, 3)
    assert {(r["image_id"], r["entry_id"], r["rank"]) for r in got.collect()} == nearest(rows[:200], asked, 0.95, 3)
    assert {(r["image_id"], r["entry_id"], r["rank"]) for r in image_index.search(queries, at, 0.95, 3, version=1).collect()} == nearest(rows[:100], asked, 0.95, 3)
    assert {(r["image_id"], r["entry_id"], r["rank"]) for r in image_index.search(queries, at, -1.0, 300).collect()} == nearest(rows[:200], asked, -1.0, 300)
    one, entries = image_index.probed(spark.createDataFrame(asked[:1], "id int, v array<double>"), at, 0.95)
    cells = {r["cell"] for r in one.collect()}
    assert len(cells) == 1 and len(entries.inputFiles()) > len(cells) * 2
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and entries.count() < 60
    assert image_index.append(frame([]), at) == 3 and image_index.manifest(spark, at).count() == image_index.manifest(spark, at, 2).count()
    empty = str(tmp_path / "empty")
    assert image_index.build(frame(odd[:2]), empty) == 1 and image_index.search(queries, empty).isEmpty()
    with pytest.raises(ValueError, match="no version 9"):
        image_index.search(queries, at, version=9)


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    at = str(tmp_path / "index")
    rows = clustered(40)
    image_index.build(spark.createDataFrame(rows[:20], "id int, embedding array<double>"), at, cells=4)
    (tmp_path / "index" / "entries" / "batch=2").mkdir()
    (tmp_path / "index" / "manifest" / "v2").mkdir()
    assert image_index.manifest(spark, at).agg(F.sum("rows")).first()[0] == 20
    with pytest.raises(Exception, match="(?i)already exists"):
        image_index.append(spark.createDataFrame(rows[20:], "id int, embedding array<double>"), at)
    assert image_index.manifest(spark, at).agg(F.sum("rows")).first()[0] == 20


def test_a_picture_is_flagged_once_by_its_earliest_match(spark, tmp_path):
    at = str(tmp_path / "index")
    e = [1.0, 0.0, 0.0]
    stored = spark.createDataFrame([("a", e, dt.date(2020, 5, 1), "flood"), ("b", e, dt.date(2019, 1, 1), "storm"), ("c", [0.0, 1.0, 0.0], dt.date(2024, 3, 1), "rally"), ("d", e, None, "undated")], "id string, embedding array<double>, first_seen date, context string")
    image_index.build(stored, at, cells=2)
    images = spark.createDataFrame([("p", "i1", 0, e, None), ("p", "i2", 1, [0.0, 1.0, 0.0], dt.date(2024, 3, 9)), ("q", "i3", 0, [0.0, 0.0, 1.0], None), ("q", "i4", 1, None, None)], "packet_id string, image_id string, image_index int, v array<double>, day date")
    claims = spark.createDataFrame([("p", "c1", 0, True), ("p", "c2", None, True), ("p", "c3", None, False)], "packet_id string, claim_id string, image_index int, check_worthy boolean")
    found, flags = image_index.passed(images, claims, at, stored, DAY)
    got = {r["image_id"]: (r["entry_id"], r["first_seen"], r["date_mismatch"]) for r in flags.collect()}
    assert got == {"i1": ("b", dt.date(2019, 1, 1), True), "i2": ("c", dt.date(2024, 3, 1), False), "i3": (None, None, False), "i4": (None, None, False)}
    assert sorted((r["claim_id"], r["image_id"], r["entry_id"], r["context"]) for r in found.collect()) == [("c1", "i1", "a", "flood"), ("c1", "i1", "b", "storm"), ("c1", "i1", "d", "undated"), ("c1", "i2", "c", "rally"), ("c2", "i2", "c", "rally")]


def test_second_round_asks_only_what_is_open(spark):
    corpus, tiers, cases = setting(spark)
    seen = []

    def reserve(claims, queries):
        seen.append(sorted({r["text"] for r in claims.collect()}))
        return claims.select("claim_id", F.lit("https://check.example.org/9").alias("url"), F.col("text").alias("title"), F.lit("True").alias("rating_raw"))

    packets = readers.text_packets(cases.where("text <> ''")).dropDuplicates(["packet_id"])
    done = lifecycle.run(packets, DAY, lifecycle.Sources(tables={"seed_index": lifecycle.seed_index(corpus)}), tiers)
    out, rounds = lifecycle.second_round(done, lifecycle.Sources(tables={"factcheck": reserve}), tiers)
    assert len(seen) == 1 and len(seen[0]) == 1 and "laptop" in seen[0][0]
    (r,) = rounds.collect()
    assert (r["before"], r["after"], r["claims"], r["found"]) == ("unverified", "true", 1, 1)
    before, after = ({r["packet_id"]: r["label"] for r in x.packets.collect()} for x in (done, out))
    assert sum(before[p] != after[p] for p in before) == 1 and out.evidence.count() == done.evidence.count() + 1
    e = evaluation.escalation(rounds, done.packets).first()
    assert (e["messages"], e["escalated"], e["settled"], e["changed"], e["found"], e["escalation_yield"]) == (done.packets.count(), 1, 1, 1, 1, 1.0)
    assert [s["stage"] for s in out.stages.collect()][4:] == ["open claims", "second evidence", "second stances", "second verdicts"]
    again, none = lifecycle.second_round(out, lifecycle.Sources(tables={"factcheck": reserve}), tiers)
    assert none.isEmpty() and evaluation.escalation(none, again.packets).first()["escalation_yield"] is None


def test_a_text_that_meets_many_claims_is_cut_once(spark):
    """Texts are cut after they are made distinct, so that one that meets many claims costs as much as one that meets one."""
    import time

    body = " ".join(f"Word{k} lemon{k} water{k} cures{k} patient{k} claim{k}." for k in range(4000))
    claims = spark.createDataFrame([(f"c{k}", f"Claim{k} lemon{k} water{k} cures{k} patient{k}") for k in range(300)], "claim_id string, text string")
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "snippet", "rating", "rating_raw", "about")]
    rows = claims.select("claim_id", F.lit("i").alias("id"), *none, F.lit(body).alias("text")).repartition(4)
    began = time.time()
    got = {r["claim_id"]: r for r in stance.judged(rows, claims).collect()}
    assert time.time() - began < 60 and len(got) == 300
    for k in (0, 7, 299):  # passages are three sentences; the last has one more
        assert f"lemon{k} " in got[f"c{k}"]["best_passage"] and got[f"c{k}"]["method"] == "nli" and got[f"c{k}"]["relevance"] == 0.527


def test_near_duplicates_equal_the_plain_fold(spark):
    """Survivors by rarer tokens are those of comparing each row with every survivor, and long messages take no square of steps."""
    import random
    import time

    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    rows = [(m, n, " ".join(rng.sample(words, rng.randint(0, 9))), rng.randint(0, 9) / 10) for m in range(12) for n in range(60)]
    want = set()
    for m in range(12):
        kept = []
        for _, n, s, c in (r for r in rows if r[0] == m):
            x = set(s.split())
            same = next((k for k in kept if x and k["x"] and len(x & k["x"]) / len(x | k["x"]) >= 0.8), None)
            if same is None:
                kept.append({"n": n, "x": x, "c": c, "w": n})
            elif c > same["c"]:
                same["c"], same["w"] = c, n
        want |= {(m, k["n"], k["c"], k["w"] % 2 == 0) for k in kept}
    df = spark.createDataFrame(rows, "m int, n int, sentence string, confidence double").withColumn("check_worthy", F.col("n") % 2 == 0)
    assert {(r["m"], r["n"], r["confidence"], r["check_worthy"]) for r in C.deduped(df.repartition(5), "m", ["n"]).collect()} == want
    long_ = spark.range(6000).select(F.lit(1).alias("m"), F.col("id").alias("n"), F.concat_ws(" ", *[F.sha1((F.col("id") * 9 + k).cast("string")) for k in range(9)]).alias("sentence"), F.lit(0.5).alias("confidence"), F.lit(True).alias("check_worthy"))
    began = time.time()
    assert C.deduped(long_, "m", ["n"]).count() == 6000 and time.time() - began < 20
