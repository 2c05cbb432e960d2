"""Text, entities, claims, evidence, graph and verdicts on small frames with the scripts, amounts and dates that the driver tables lack."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from claimloom.functions import entities, hindi, ids, spans, text, urls, vectors
from claimloom.operators import agents, evaluation, graph, media, stance, verdict
from claimloom.operators import claims as C
from claimloom.operators import evidence as EV
from claimloom.sources import readers, sinks

from tests import plain_entities

DAY = dt.date(2024, 3, 10)


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_sentences_hold_abbreviations(spark):
    assert one(spark, text.sentences(text.clean(F.col("t"))), t=" Dr. Rao met Mr. Das.  It rained!\r\nयह सच है। अच्छा\tहै ") == ["Dr. Rao met Mr. Das.", "It rained!", "यह सच है।", "अच्छा है"]
    spans = one(spark, text.sentence_spans(F.col("t")), t="One two. Three four.\nFive")
    assert [(s["start"], s["end"]) for s in spans] == [(0, 8), (9, 20), (21, 25)]


def test_passages_borrow_and_break(spark):
    assert one(spark, text.passages(F.col("t")), t="A. B. C. D.") == ["A. B.", "C. D."]
    assert one(spark, text.passages(F.col("t")), t="") == []
    long = one(spark, text.passages(F.col("t")), t="word " * 400)
    assert all(len(p) <= 3 * 801 for p in long) and sum(p.count("word") for p in long) == 400


def test_stems_and_terms(spark):
    words = ["vaccines", "cities", "glasses", "glass", "thing", "making", "wanted", "bed", "पानी"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["x"] for r in df.select(text.stem(F.col("w")).alias("x")).collect()] == ["vaccin", "city", "glass", "glass", "thing", "making", "want", "bed", "पानी"]
    assert set(one(spark, text.content_terms(F.col("t")), t="The vaccines cause पानी में fever")) == {"vaccin", "caus", "पानी", "fever"}


def test_language_and_scripts(spark):
    lex = text.Lexicon(native={"sarkar": "सरकार", "paani": "पानी", "muft": "मुफ्त"})
    assert one(spark, text.language(F.col("t")), t="sarkar ne kaha hai ki paise do") == "hinglish"
    assert one(spark, text.language(F.col("t")), t="यह सच है") == "hi" and one(spark, text.language(F.col("t")), t="plain english words only") == "en"
    assert one(spark, lex.devanagari(F.col("t")), t="Sarkaar paani degi SBI") == "सरकार पानी degi SBI"
    assert one(spark, lex.devanagari(F.col("t")), t="the sarkar gives water to all people here today") is None
    assert one(spark, lex.romanised(F.col("t")), t="सरकार ने पानी।") == "sarkar ने pani।"
    assert one(spark, lex.spellings(F.col("t")), t=" muft paani ") == ["muft paani", "मुफ्त पानी"]
    for w in ("paani", "bahuuut", "theek", "accha", "zaroor", "woh"):
        assert one(spark, text.fold_spelling(F.col("w")), w=w) == text.Lexicon.fold(w)


SENTENCES = [
    "Send Rs 5,000 to help@paytm or 9876543210 by 5 May 2024, 12% off at www.x.in #Free says Reserve Bank", "2 lakh crore and ₹2 lakh, $3 million, 5k, 10 cr, 10 crores, € 12.50, USD 7 billion", "Kal shaam ko ghar", "Modi announces it",
    "Dr Anil Rao of Delhi", "The Reserve Bank of India and the SBI met Mr Das in New Delhi", "Massive earthquake in Nepal; Massive!", "RBI says 3.5 percent growth on 12/05/2023, 12-5-23, 2023-05-12, May 2023, 5 May, May 5th, June 3, 2020 and sept 2020, Sept 2020",
    "yesterday 3 days ago 2 months ago 5 years ago 99999999 years ago today tonight last week next month recently daily every monday", "x5 5.5.5 a.5 5a 1,000 1,000.50 million 7 8 9", "http://A.b/c?d www.foo.com, HTTPS://X.Y",
    "call +91 9876543210 or 09876543210 or 98765432101", "me@upi you@ybl a.b-c@okaxis z@gmail.com", "Prime Minister Modi said. President Biden", "Namak: lekar aana", "note: Forward this", "हिंदी #हिंदी में 5 लाख", "Apple's Tim O'Brien-Smith visited",
    "31 Feb 2024 and 2021", "Rs.5 Rs 5 INR5 5 rupees 5 rupaye", "1st January 2024, 22nd of March", "May will come. 1 May", "The. A An", "to The Who", "", " ", "Delhi", "Delhi is hot", "USA", "Ok Google. Hey Google", "Running shoes. Running", "Walks fast", "Paris he walks", None,
]


def test_romanised_hindi_out_of_the_box(spark):
    lex = text.Lexicon.hindi()
    for given, want in (("garam paani peene se corona theek ho jata hai", "गरम पानी पीने से कोरोना ठीक हो जाता है"), ("Sarkaar sabko muft laptop degi, SBI bank mein", "सरकार sabko मुफ्त लैपटॉप degi, SBI बैंक में"), ("The bank will send me the note", None), ("यह सच है", None), ("", None), (None, None)):
        assert one(spark, lex.devanagari(F.col("t")), t=given) == want, given
    assert one(spark, lex.romanised(F.col("t")), t="सरकार का पानी") == "sarkar ka pani" and one(spark, lex.script(F.col("t")), t="kya yeh sach hai") == "hinglish"
    assert [hindi.by_rule(w) for w in ("paani", "kya", "hain", "mantri", "bachche", "sandesh", "zaroor", "aurat", "logon", "")] == ["पानी", "क्या", "हैं", "मंत्री", "बच्चे", "संदेश", "ज़रूर", "औरत", "लोगों", ""]
    words = [r["w"] for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct().limit(300).collect()]
    df = spark.createDataFrame([(" ".join(words[k : k + 7]),) for k in range(0, len(words), 7)], "t string")
    for r in df.select("t", lex.hits(F.col("t")).alias("h"), lex.transliterate(F.col("t")).alias("x")).collect():
        own = r["t"].split(" ")
        assert r["h"]["hits"] == sum(lex.fold(w) in lex.native for w in own)
        assert r["x"] == " ".join(w if len(w) > 1 and w.isupper() else lex.all.get(lex.fold(w), w) for w in own)


def test_a_lexicon_of_a_table(spark):
    rows = [("paani", "पानी", "native", 1), ("sarkar", "पुराना", "native", 1), ("sarkar", "सरकार", "native", 2), ("sarkar", "सरकार2", "native", 2), ("laptop", "लैपटॉप", "loan", 2), ("kam", "काम", "ambiguous", 2), ("gone", None, "native", 2), ("degi", "देगी", "native", 2)]
    df = spark.createDataFrame(rows, "roman string, devanagari string, kind string, version int")
    assert one(spark, text.Lexicon.of_table(df).transliterate(F.col("t")), t="Sarkar degi laptop paani kam gone") == "सरकार देगी लैपटॉप paani काम gone"
    assert one(spark, text.Lexicon.of_table(df, 1).transliterate(F.col("t")), t="sarkar paani") == "पुराना पानी"
    with pytest.raises(ValueError, match="more than 2 words"):
        text.Lexicon.of_table(df, most=2)
    assert one(spark, text.Lexicon.of_table(df.limit(0)).transliterate(F.col("t")), t="sarkar") == "sarkar"


def test_spans_equal_plain_rules(spark):
    """Column expressions against the rules in plain Python, on hard sentences and on all of the smallest table."""
    hand = spark.createDataFrame([(s,) for s in SENTENCES], "sentence string")
    docs = C.sentence_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), ["doc_id"]).select("sentence")
    for r in C.with_spans(hand.unionByName(docs), DAY).select("sentence", "entities", "times").toLocalIterator():
        want = plain_entities.entities_of(r["sentence"] or "", DAY)
        assert [tuple(x) for x in r["entities"]] == want, r["sentence"]
        assert [tuple(x) for x in r["times"]] == plain_entities.times_of(r["sentence"] or "", DAY, want), r["sentence"]


def test_entities_by_precedence(spark):
    found = {e["label"]: (e["text"], e["normalized"]) for e in one(spark, entities.entities(F.col("t"), DAY), t=SENTENCES[0])}
    assert found["MONEY"] == ("Rs 5,000", "INR 5000") and found["UPI"][1] == "help@paytm" and found["PHONE"][1] == "9876543210"
    assert found["DATE"][1] == "2024-05-05" and found["PERCENT"][1] == "12%" and found["URL"][1] == "www.x.in" and found["HASHTAG"][1] == "#free" and found["ORG"][0] == "Reserve Bank"
    money = lambda t: one(spark, entities.money(F.col("t")), t=t)
    assert money("2 lakh crore") == "INR 20000000" and money("₹2 lakh") == "INR 200000" and money("no amount") is None and money("₹५०० लाख") == "INR 500"
    assert money("$3 million") == "USD 3000000" and money("5k") == "INR 5000" and money("10 cr") == "INR 100000000"
    labels = lambda s: [(e["text"], e["label"]) for e in one(spark, entities.entities(F.col("t"), DAY), t=s)]
    assert labels("Kal shaam ko ghar") == [] and labels("Modi announces it") == [("Modi", "PROPER")] and labels("Dr Anil Rao of Delhi")[0][1] in ("PERSON", "GPE")
    assert labels("₹५,००० दिए") == [("₹५,०००", "MONEY")]


def test_model_spans(spark):
    """A tagger's spans fill what patterns leave, and win over names by capitals; a language model's are put where the sentence has them."""
    s = "Foo paid 5% to bar in Old Town"
    hits = "array<struct<entity_group:string,score:double,start:int,end:int>>"
    df = spark.createDataFrame([(s, [("ORG", 0.9, 0, 3), ("LOC", 0.9, 8, 12), ("PER", 0.59, 15, 18), ("MISC", 0.6, 14, 18), ("DATE", 0.9, 4, 8), ("PER", 0.9, 4, 5), ("PER", 0.9, 26, 30)]), (s, None), (None, [])], f"s string, h {hits}")
    rows = df.select(entities.model_entities(F.col("s"), F.col("h")).alias("m"), entities.entities(F.col("s"), DAY, entities.model_entities(F.col("s"), F.col("h"))).alias("e")).collect()
    assert [(e["text"], e["label"], e["start"], e["end"]) for e in rows[0]["m"]] == [("Foo", "ORG", 0, 3), ("5%", "GPE", 8, 10), ("bar", "PROPER", 14, 17), ("Town", "PERSON", 26, 30)]
    assert [(e["text"], e["label"]) for e in rows[0]["e"]] == [("Foo", "ORG"), ("5%", "PERCENT"), ("bar", "PROPER"), ("Town", "PERSON")]
    assert rows[1]["m"] == [] and [(e["text"], e["label"]) for e in rows[1]["e"]] == [("5%", "PERCENT"), ("Old Town", "PERSON")] and rows[2]["e"] == []
    named = "array<struct<text:string,label:string>>"
    df = spark.createDataFrame([("He met RAO today", [("rao", "PERSON"), ("gone", "ORG"), ("", "ORG"), (None, "ORG")])], f"s string, n {named}")
    assert [(e["text"], e["normalized"], e["start"], e["end"]) for e in df.select(entities.anchored(F.col("s"), F.col("n")).alias("x")).first()["x"]] == [("RAO", "rao", 7, 10)]
    both = df.select(entities.merged(F.array(entities._entity("ORG", F.lit("met RAO"), F.lit(None).cast("string"), F.lit(3), F.lit(10))), entities.anchored(F.col("s"), F.col("n"))).alias("x")).first()["x"]
    assert [e["label"] for e in both] == ["ORG"]


def test_matches_and_overlaps(spark):
    got = one(spark, spans.matches(F.col("t"), "[0-9]+"), t="12 a3\ue0004 ५5")
    assert [(m["text"], m["start"], m["end"]) for m in got] == [("12", 0, 2), ("3", 4, 5), ("4", 6, 7), ("५5", 8, 10)]
    assert one(spark, spans.matches(F.col("t"), "x"), t=None) == [] == one(spark, spans.matches(F.col("t"), "x"), t="")
    at = F.expr("from_json(t, 'array<struct<start:int,end:int>>')")
    kept = one(spark, spans.resolved(at, "struct<start:int,end:int>"), t='[{"start":5,"end":9},{"start":0,"end":6},{"start":0,"end":5},{"start":9,"end":9},{"start":6,"end":7}]')
    assert [(k["start"], k["end"]) for k in kept] == [(0, 5), (5, 9), (9, 9)]


@pytest.mark.parametrize("given,want", [("1st January 2024", "2024-01-01"), ("03/04/2024", "2024-04-03"), ("May 2023", "2023-05-01"), ("2021", "2021-01-01"), ("5 May", "2024-05-05"), ("31 Feb 2024", None)])
def test_absolute_dates(spark, given, want):
    assert one(spark, entities.absolute_date(F.col("t"), DAY), t=given) == want == plain_entities.absolute_date(given, DAY)


def test_a_run_of_thousands_of_names(spark):
    """A junk text of capitalised words is one name; a search that goes a call deeper each word ends the stack, and with it the executor."""
    s = "we met " + "Asha of Kavita and\tRao " * 3000 + "Goa of the Sea and left Delhi"
    df = spark.createDataFrame([(s,)], "s string").repartition(2)  # in a task, whose stack is that of an executor
    got = [tuple(x) for x in df.select(entities.entities(F.col("s"), DAY).alias("e")).first()["e"]]
    assert got == plain_entities.entities_of(s, DAY) and max(len(x[1].split()) for x in got) > 15_000


def test_relative_dates_and_times(spark):
    relative = lambda t: one(spark, entities.relative_date(F.col("t"), DAY), t=t)
    assert relative("2 months ago") == "2024-01-10" and relative("yesterday") == "2024-03-09" and relative("recently") is None and relative("9999999999999999999999 years ago") is None
    s = "Rs 2000 was paid yesterday and every week since 2021"
    got = C.with_spans(spark.createDataFrame([(s,)], "sentence string"), DAY).first()["times"]
    assert [(t["text"], t["kind"]) for t in got] == [("yesterday", "relative"), ("every week", "recurring"), ("2021", "absolute")]


def test_source_dates(spark):
    rows = [("2020:05:17 10:00:00", "2020-05-17"), ("17/05/2020", "2020-05-17"), ("05-17-2020", "2020-05-17"), ("2020-05", "2020-05-01"), ("2020", "2020-01-01"), ("nothing", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [str(r["x"]) if r["x"] else None for r in df.select(entities.iso_date(F.col("t")).alias("x")).collect()] == [w for _, w in rows]
    assert str(one(spark, entities.iso_date(F.col("t"), exif=False), t="2020:05:17")) == "2020-01-01"
    assert str(one(spark, entities.result_date(F.col("t")), t="seen on May 5, 2020 there")) == "2020-05-05" and str(one(spark, entities.result_date(F.col("t")), t="5 May 2020")) == "2020-05-05"


def test_scoring_and_types(spark):
    rows = [("Government announced a free ration scheme of Rs 5000 for all today",), ("Hello!",), ("Is it going to rain in the city today?",), ("I love my friends and we are happy",), ("Forward this message to win a free gift now",)]
    df = C.scored(C.with_entities(C.with_features(spark.createDataFrame(rows, "sentence string")), DAY))
    got = {r["sentence"]: r for r in df.collect()}
    first = got[rows[0][0]]
    assert first["check_worthy"] and first["claim_type"] == "chain_offer" and first["drop_reason"] is None
    assert got["Hello!"]["points"] == 0 and got["Hello!"]["drop_reason"] == "greeting" and got[rows[2][0]]["drop_reason"] == "question"
    assert got[rows[3][0]]["drop_reason"] in ("opinion", "personal") and got[rows[4][0]]["claim_type"] == "chain_offer"


def test_packets_to_claims(spark):
    p = readers.text_packets(spark.createDataFrame([("The minister said Reserve Bank banned 500 notes today. The minister said Reserve Bank banned 500 notes today! Ok.",)], "text string"))
    rows = C.extract(p, DAY).collect()
    worthy = [r for r in rows if r["check_worthy"]]
    assert len(worthy) == 1 and worthy[0]["claim_id"].startswith("clm_") and worthy[0]["numbers"] == ["500"]


def test_greedy_dedupe_is_not_components(spark):
    a, b, c = "a b c d e f g h i", "a b c d e f g h j", "a b c d e f g k j"
    df = spark.createDataFrame([(1, k, 0, s, 0.1 * k, False) for k, s in enumerate((a, b, c), 1)], "packet_id int, pos int, n int, sentence string, confidence double, check_worthy boolean")
    got = sorted((r["pos"], r["confidence"]) for r in C.deduped(df, "packet_id", ["pos", "n"]).collect())
    assert [p for p, _ in got] == [1, 3] and abs(got[0][1] - 0.2) < 1e-9


def test_urls_and_tiers(spark):
    for given, want in (("HTTP://www.Example.com:80/a/amp/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"), ("example.com/x/", "https://example.com/x"), ("https://h.in:8080/?ref=1", "https://h.in:8080/"), ("", "")):
        assert one(spark, urls.canonical_url(F.col("u")), u=given) == want
    df = spark.createDataFrame([("factcheck.pib.gov.in",), ("news.site.in",), ("unknown.org",)], "domain string")
    got = {r["domain"]: (r["tier"], r["source_weight"]) for r in urls.with_tier(df, spark.createDataFrame([("pib.gov.in", "government"), ("site.in", "news"), ("site.in/fact-check", "factchecker")], "entry string, tier string")).collect()}
    assert got == {"factcheck.pib.gov.in": ("government", 0.9), "news.site.in": ("factchecker", 1.0), "unknown.org": ("other", 0.5)}


def test_ratings_disagree_on_purpose(spark):
    df = spark.createDataFrame([("Half True",), ("Unverified",), ("Misleading",), ("भ्रामक",), ("Mostly True",), ("?",)], "r string")
    got = [(x["a"], x["b"]) for x in df.select(text.rating_group(F.col("r")).alias("a"), text.rating_stance(F.col("r")).alias("b")).collect()]
    assert got == [("misleading", "neutral"), ("misleading", "neutral"), ("misleading", "refute"), ("misleading", "refute"), ("true", "support"), ("unknown", None)]


def test_aboutness(spark):
    ask = lambda a, b: one(spark, EV.about(F.col("a"), F.col("b"))["answer"], a=a, b=b)
    assert ask("lemon water cures cancer quickly", "doctors deny lemon water cures cancer") == "about" and ask("lemon water cures cancer quickly", "bank notes banned tomorrow night everywhere") == "not_about"
    assert ask("short", "lemon water cures cancer") == "unclear" and ask("", "x") == "unclear" and ask("lemon water cures cancer", "नींबू पानी कैंसर ठीक करता") == "unclear"


def test_pairs_of_repeated_and_missing_ids(spark, tmp_path):
    """Rows that share an id, or have none, against SQL: none of their pairs is left out."""
    import random

    import duckdb

    from claimloom.plans import catalogue, oracles

    rng = random.Random(3)
    word = lambda: f"word{int(rng.paretovariate(0.7)) % 50}"
    line = lambda n: " ".join(word() for _ in range(n))
    claims = [(k // 2 if k < 30 else k, line(rng.randint(4, 9))) for k in range(60)] + [(None, line(6)), (None, line(6)), (3, None), (90, "one two three four five six"), (90, "seven eight nine ten eleven twelve"), (91, "red green blue gold grey pink")]
    docs = [(k % 50, line(rng.randint(2, 20))) for k in range(90)] + [(None, line(9)), (None, line(9)), (5, None), (200, "seven eight nine ten eleven twelve"), (201, "red green"), (201, "blue gold")]
    con = duckdb.connect()
    for name, key, rows in (("benchmark", "item_id", claims), ("documents", "doc_id", docs)):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    read = lambda name, cols: (getattr(catalogue, name)(spark, str(tmp_path)).selectExpr(*cols).collect(), con.execute(f"SELECT {', '.join(cols)} FROM ({oracles.SQL[name]})").fetchall())
    ordered = lambda rows: sorted(str(tuple(r)) for r in rows)
    got, want = read("aboutness", ["claim_id", "item_id", "answer", "shared", "claim_only", "evidence_only"])
    assert ordered(got) == ordered(want) and {(90, 200), (91, 201)} <= {r[:2] for r in got}
    got, want = read("claim_overlap_topk", ["claim_id", "rank", "CAST(shared AS DOUBLE) / terms AS overlap"])  # an item may tie with itself where a claim has two counts of words
    assert ordered(got) == ordered(want)


def test_queries(spark):
    df = spark.createDataFrame([("c1", "RBI banned 500 notes http://x.y", "policy", "hi", ["RBI", "rbi", "500"], ["2024-01-01"])], "claim_id string, text string, claim_type string, language string, terms array<string>, dates array<string>")
    got = EV.build_queries(df).orderBy("rank").collect()
    assert [(r["kind"], r["language"]) for r in got] == [("verbatim", "hi"), ("routed", "hi"), ("routed", "hi")] and got[0]["text"] == "RBI banned 500 notes" and "rbi.org.in" in got[1]["sites"]
    assert one(spark, text.truncated(F.col("t"), 10), t="abc defghi jkl") == "abc"


def test_dedupe_inherits(spark):
    cols = "claim_id string, url string, title string, snippet string, text string, publisher string, published_date string, rating string, rating_raw string, language string, decisive boolean, demo boolean, source_type string, seq int"
    rows = [("c", "http://a.in/x?utm_x=1", "T", "short", None, "P", None, "unknown", None, None, False, False, "web", 1), ("c", "https://www.a.in/x/", "T2", "a longer snippet", None, None, "2024-01-01", "false", "False", None, False, True, "factcheck", 2), ("c", None, "T", None, None, None, None, "unknown", None, None, False, False, "web", 3)]
    got = sorted(EV.deduped(spark.createDataFrame(rows, cols)).collect(), key=lambda r: -r["copies"])
    assert len(got) == 2 and got[0]["snippet"] == "a longer snippet" and got[0]["publisher"] == "P" and got[0]["rating"] == "false" and got[0]["demo"] and got[0]["also_found_by"] == ["web"]


def test_totals_and_cascade(spark):
    cols = "claim_id int, id int, stance string, score double, weight double, decisive boolean, demo boolean, rating string"
    rows = [(1, 1, "refutes", 1.0, 1.0, True, False, "misleading"), (2, 1, "refutes", 0.9, 0.0, False, False, "unknown"), (2, 2, "refutes", None, 0.5, False, False, "unknown"), (3, 1, "supports", 1.0, 1.0, False, True, None), (4, 1, "supports", 0.9, 1.0, False, False, None), (4, 2, "refutes", 0.9, 1.0, False, False, None), (5, 1, None, None, 1.0, False, False, None)]
    claims = spark.createDataFrame([(1, k) for k in range(1, 8)], "packet_id int, claim_id int")
    flag = lambda k: spark.createDataFrame([(k,)], "claim_id int")
    v = verdict.for_claims(claims, spark.createDataFrame(rows, cols), flag(6), flag(7))
    got = {r["claim_id"]: (r["label"], r["rule"], round(r["confidence"], 4)) for r in v.collect()}
    assert got[1] == ("misleading", "decisive", 0.9) and got[2] == ("false", "weighted", round(0.5 + 0.95 / 4, 4)) and got[3] == ("true", "weighted", 0.6) and got[4] == ("disputed", "disputed", 0.4)
    assert got[5] == ("unverified", "unverified", 0.2) and got[6] == ("misleading", "recycled", 0.75) and got[7] == ("misleading", "mismatch", 0.6)
    p = verdict.roll_up(v).first()
    assert p["label"] == "false" and p["n_misleading"] == 3 and p["n_claims"] == 7


@pytest.mark.parametrize("some_open", [False, True])
def test_verdict_queries_read_all_stances(spark, tmp_path, some_open):
    """Against their SQL without its row filters: the SQL as registered keeps 2 of 7 or 1 of 10 events. In the table at
    hand all claims are closed; without the heavy stances of a third of the users theirs stay open."""
    import duckdb

    from claimloom.plans import catalogue, oracles

    d = "/root/testdata/sf0.01"
    if some_open:
        spark.read.parquet(f"{d}/events.parquet").where("user_id % 3 <> 0 OR event_id % 4 <> 3").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        d = str(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet{"/*.parquet" if some_open else ""}')")
    for name in ("open_claims", "escalation", "claim_verdict", "packet_verdict"):
        got = getattr(catalogue, name)(spark, d)
        whole = oracles.SQL[name].replace("seq % 10 = 0 AND ", "").replace(" WHERE seq % 7 < 2", "")
        want = con.execute(whole)
        columns = [c[0] for c in want.description]
        rows = want.fetchall()
        assert bool(rows) == (some_open or name.endswith("verdict"))
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, rows)), name


def test_graph_upserts_and_round_trip(spark):
    log = spark.createDataFrame([("p", "a", "claim", {"x": "1", "y": "2"}, 1), ("p", "a", "claim", {"x": "3"}, 2), ("p", "b", "image", None, 1)], "packet_id string, id string, kind string, attrs map<string,string>, seq int")
    nodes = graph.upsert_nodes(log, "seq")
    assert {r["id"]: r["attrs"] for r in nodes.collect()} == {"a": {"x": "3", "y": "2"}, "b": {}}
    edges = graph.upsert_edges(spark.createDataFrame([("p", "a", "b", "T", "", {"k": "1"})] * 2, "packet_id string, src string, dst string, type string, via string, attrs map<string,string>"))
    n, e = graph.from_json(graph.to_json(nodes, edges))
    assert sorted(map(str, n.collect())) == sorted(map(str, nodes.select(n.columns).collect())) and e.collect() == edges.select(e.columns).collect()
    assert graph.dangling(edges, nodes.where("id = 'a'")).count() == 1 and "a" in sinks.graph_html(graph.to_json(nodes, edges).first()["graph"])
    with pytest.raises(Exception, match="two kinds"):
        graph.upsert_nodes(log.unionByName(log.limit(1).withColumn("kind", F.lit("image"))), "seq").collect()


def test_votes_gates_and_media(spark):
    v = spark.createDataFrame([(1, 0, "neutral", 0.9), (1, 1, "refutes", 0.6), (1, 2, "supports", 0.6), (2, 0, "neutral", 0.7), (2, 1, "refutes", 0.4)], "k int, pos int, stance string, score double")
    assert {r["k"]: (r["stance"], r["pos"]) for r in stance.strongest(v, ["k"]).collect()} == {1: ("refutes", 1), 2: ("neutral", 0)}
    frames = spark.createDataFrame([(1, 1.0, [1.0, 0.0]), (1, 2.0, [1.0, 0.01]), (1, 3.0, None), (1, 4.0, [0.0, 1.0])], "packet_id int, frame_time double, embedding array<double>")
    assert sorted(r["frame_time"] for r in media.keyframes(frames).collect()) == [1.0, 3.0, 4.0]
    c = spark.createDataFrame([(0.1, None), (0.1, 0.5), (0.9, None), (None, None)], "a double, b double")
    assert [r["x"]["mismatch"] for r in c.select(media.consistency(F.col("a"), F.coalesce("b", F.col("a"))).alias("x")).collect()] == [True, False, False, False]
    e = spark.createDataFrame([(k, [float(k == j) for j in range(3)]) for k in range(3)], "id int, v array<double>")
    assert vectors.similar_pairs(e, e, 0.5).count() == 0
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_evaluation(spark):
    cols = "id string, language string, category string, verdict string, expected_verdict string, check_worthy boolean, expected_check_worthy boolean, expected_seed_id string, retrieved_seed_ids array<string>, in_corpus boolean"
    rows = [("1", "en", "x", "false", "false", True, True, "s", ["s"], True), ("2", "hi", "x", "false", "true", True, False, None, ["z"], False), ("3", "hi", "y", None, "true", None, True, "t", None, False)]
    s = {(r["block"], r["value"]): r for r in evaluation.summary(spark.createDataFrame(rows, cols)).collect()}
    o = s["overall", None]
    assert (o["n"], o["n_verdicts"], o["correct"], o["false_accusations"], o["tp"], o["fp"], o["targeted"], o["hits"], o["strays"]) == (3, 2, 1, 1, 1, 1, 1, 1, 1)
    assert len(s) == 7 and s["language", "hi"]["accuracy"] == 0.0 and "overall" in evaluation.rendered(evaluation.summary(spark.createDataFrame(rows, cols)))


def test_agents_plan_and_run(spark):
    seen = {"has_text": True}
    assert [s.agent for s in agents.plan(seen)] == ["claims", "evidence", "verification", "explanation"]
    assert [s.agent for s in agents.parsed_plan('x {"steps": [{"agent": "claims"}, {"agent": "verification"}]} y', seen)] == ["claims", "verification"]
    assert len(agents.parsed_plan("no json", seen)) == 4 and len(agents.parsed_plan('[{"agent": "rm"}]', seen)) == 4
    tools = {"claims": lambda s: {"n_worthy": 1}, "evidence": lambda s: {"asked": s.get("asked", 0) + 1}, "verification": lambda s: 1 / 0, "explanation": lambda s: {}}
    state, trace = agents.run(agents.plan(seen), tools, dict(seen), lambda s: True)
    assert state["asked"] == 2 and trace.frame(spark).where("error IS NOT NULL").count() == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\nnot json\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, text string").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, text string", strict=True).collect()
    with pytest.raises(ValueError):
        readers.unique_ids(spark.createDataFrame([("1",), ("1",)], "id string"))
    (tmp_path / "pic.png").write_bytes(b"123")
    img = readers.image_files(spark, str(tmp_path / "pic.png"), lambda p, c: {"ocr_text": str(len(c))}).first()
    assert img["ocr_text"] == "3" and img["embedding"] is None
    q = spark.createDataFrame([("c", "hello"), ("d", "bad")], "claim_id string, text string")
    answers = readers.service(q, lambda t: '{"claims": [{"text": "s", "claimReview": [{"url": "u", "textualRating": "False", "publisher": {"name": "P", "site": "p.in"}}]}]}' if t == "hello" else 1 / 0, readers.FACT_CHECKS)
    assert [(r["claim_id"], r["rating_raw"], r["domain"]) for r in readers.fact_check_candidates(answers).collect()] == [("c", "False", "p.in")]
    cache = sinks.Cache(spark, str(tmp_path / "cache"))
    asked = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert cache.split(asked)[1].count() == 2
    cache.put(spark.createDataFrame([("k1", "v"), ("k2", None)], "key string, value string"))
    hits, misses = cache.split(asked)
    assert [r["value"] for r in hits.collect()] == ["v"] and misses.count() == 1
    assert readers.available({"a": lambda: True, "b": lambda: 1 / 0}) == {"a": True, "b": False}
    assert one(spark, text.html_text(F.col("h")), h="<head><title>x</title></head><body><p>A &amp; B</p><script>no</script><p>C</p></body>") == "A & B\nC"
    assert one(spark, ids.stable_id("ent", F.lit("A"), F.lit(None)))[:4] == "ent_"


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "claimloom", tmp_path / "claimloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.strip().endswith("False"), said.stderr


def test_copies_of_a_vector_tie(spark):
    """Similarities are those of the plain sums in order, so that of equal vectors the smaller ids are taken."""
    import random

    from claimloom.functions import vectors

    rng = random.Random(3)
    kinds = [[rng.gauss(0, 1) for _ in range(48)] for _ in range(40)]
    rows = [(k, kinds[k % 40]) for k in range(640)]
    df = spark.createDataFrame(rows, "id long, v array<double>")

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    like = lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))
    want = set()
    for k, v in rows[::20]:
        near = sorted((-s, j) for j, w in rows if j != k and (s := like(v, w)) >= 0.25)
        want |= {(k, j, rank + 1, -s) for rank, (s, j) in enumerate(near[:18])}
    got = vectors.similar_pairs(df.where("id % 20 = 0"), df, 0.25, 18)
    assert {(r["left_id"], r["right_id"], r["rank"], r["similarity"]) for r in got.collect()} == want
