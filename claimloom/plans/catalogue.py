"""Queries over the driver tables: one for each operator or family, with production parameters and whole tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import entities as E
from claimloom.functions import ids, text, urls, vectors
from claimloom.functions import vocab as V
from claimloom.operators import agents, evaluation, graph, image_index, media, model_claims, stance, verdict
from claimloom.operators import claims as C
from claimloom.operators import evidence as EV
from claimloom.plans import evaluate, lifecycle
from claimloom.sources import fanout, readers, sinks
from claimloom.sources.folders import shared_folder
from claimloom.streaming import ingest

TODAY = dt.date(2024, 2, 1)
#: Listings of the pages' hosts for the tier query: a configuration, small and fixed.
TIERS = [("example.org", "news"), ("example.com", "other"), ("cheap-pills.example.com", "blog"), ("spam-farm.example.org", "blog"), ("example.net", "government"), ("thther.example.org/fact-check", "factchecker")]
RATINGS = ["False", "Half True", "Mostly True", "Unverified", "Misleading", "Pants on Fire!", "Satire", "Correct", "legend", "Outdated", "", "no rating yet", "Not true", "भ्रामक", "सच"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return readers.table(spark, d, name, spread=name in ("documents", "conversations", "pages"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_rows(_t(spark, d, "documents").select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return C.scored(C.with_features(_sentences(spark, d), plain=True))


def clean_text(spark, d):
    c = text.clean(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.length(c).alias("n"), F.sha1(c).alias("digest"))


def sentences(spark, d):
    return _sentences(spark, d).select("doc_id", "sentence")


def sentence_stats(spark, d):
    return _sentences(spark, d).groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("sentences"), F.sum(text.n_tokens(F.col("sentence"))).alias("tokens"))


def sentence_offsets(spark, d):
    c = _t(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("t"))
    return c.select("doc_id", "t", F.explode(text.sentence_spans(F.col("t"))).alias("s")).select("doc_id", "s.start", "s.end", "s.text")


def passages(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(text.passages(F.col("text"))).alias("pos", "passage"))


def body_join(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("a"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("b"), F.regexp_extract("html", "<b>([^<]*)<", 1).alias("c"))
    return p.select("page_id", text.body(F.col("a"), F.col("b"), F.col("c")).alias("body"))


def claim_ids(spark, d):
    s = _sentences(spark, d).withColumn("packet", ids.packet_id(F.lit("text"), F.col("doc_id").cast("string"), F.lit(0))).withColumn("normalized", text.normalize(F.col("sentence")))
    return s.select("doc_id", ids.claim_id(F.col("packet"), F.col("normalized")).alias("claim_id"), "normalized").distinct()


def packet_ids(spark, d):
    a = readers.text_packets(_t(spark, d, "documents"), keys=["doc_id"]).select(F.col("doc_id").alias("key"), F.lit("documents").alias("origin"), "packet_id")
    b = readers.text_packets(_t(spark, d, "conversations").where("role = 'user'"), keys=["conv_id"]).select(F.col("conv_id").alias("key"), F.lit("conversations").alias("origin"), "packet_id")
    return a.unionByName(b)


def top_terms(spark, d):
    t = _t(spark, d, "documents").select("doc_id", F.explode(text.content_terms(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("docs")).where("docs >= 5")


def language_tag(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").unionByName(_t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text"))
    lex = text.Lexicon(native=V.AMBIGUOUS)
    return rows.select("key", text.language(F.col("text")).alias("language"), text.hinglish_hits(F.col("text")).alias("hits"), lex.script(F.col("text")).alias("script"))


def hinglish_rewrites(spark, d):
    """Turns whose words the built-in lexicon knows: how many open the gate, and what they read as in Devanagari."""
    lex = text.Lexicon.hindi()
    t = F.col("text")
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "text", lex.hits(t).alias("h"), lex.script(t).alias("script"))
    return rows.where("h.hits > 0").select("conv_id", "turn", "h.hits", "h.words", "script", F.sha1(lex.transliterate(t)).alias("rewritten"))


def fold_spelling(spark, d):
    w = _t(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return w.groupBy(text.fold_spelling(F.col("w")).alias("folded")).agg(F.count_distinct(F.lower("w")).alias("spellings"), F.count("*").alias("n"))


def entity_scan(spark, d):
    s = _sentences(spark, d).select("doc_id", E.entities(F.col("sentence"), TODAY).alias("entities"))
    return s.select("doc_id", F.explode("entities").alias("e")).groupBy("e.label", "e.id").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"))


def time_refs(spark, d):
    # names hide no time, so they are not looked for; what does is read only where there is a time
    s = F.col("sentence")
    s = _sentences(spark, d).select("doc_id", E.times(s, TODAY, E.entities(s, TODAY, names=False)).alias("times"))
    return s.select("doc_id", F.explode("times").alias("t")).groupBy("t.kind", "t.text", "t.normalized").agg(F.count("*").alias("n"))


def feature_flags(spark, d):
    s = C.with_features(_sentences(spark, d), plain=True)
    return s.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in [*C.FEATURES, *C.PLAIN]])


def checkworthy_score(spark, d):
    return _scored(spark, d).select("doc_id", "sentence", "points", "check_worthy", "claim_type", "drop_reason")


def claim_topk(spark, d):
    return C.top(_scored(spark, d).groupBy("doc_id", "sentence").agg(F.max("confidence").alias("confidence"), F.min("claim_type").alias("claim_type"), F.bool_or("check_worthy").alias("check_worthy")), "doc_id", 1, "confidence", "sentence").drop("rank")


def priority_topk(spark, d):
    s = _scored(spark, d).where("check_worthy").select("doc_id", "sentence", "claim_type", "confidence").distinct().withColumn("priority", C.priority())
    return C.top(s, "doc_id", 8, "priority", "sentence").select("doc_id", "sentence", "rank", F.round("priority", 6).alias("priority"))


def claim_dedupe(spark, d):
    rows = C.sentence_rows(_t(spark, d, "conversations"), ["conv_id", "turn"])
    rows = C.scored(C.with_features(rows, plain=True))
    return C.deduped(rows, "conv_id", ["turn", "n"]).select("conv_id", "turn", "n", "sentence", "confidence")


def canonical_url(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"), urls.domain(F.col("url")).alias("domain"))


def source_tier(spark, d):
    p = _t(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))
    return urls.with_tier(p, spark.createDataFrame(TIERS, "entry string, tier string")).select("page_id", "domain", "tier", "source_weight")


def page_dedupe(spark, d):
    p = _t(spark, d, "pages").select(
        urls.domain(F.col("url")).alias("claim_id"), F.regexp_replace(F.lower("url"), r"\?page=.*$|\.html$", "").alias("url"), F.lit(None).cast("string").alias("text"), F.regexp_extract("html", "<b>([^<]*)<", 1).alias("snippet"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit(None).cast("string").alias("published_date"), F.lit("unknown").alias("rating"), (F.col("page_id") % 7 == 0).alias("decisive"), F.lit(False).alias("demo"),
        F.when(F.col("page_id") % 2 == 0, "web").otherwise("factcheck").alias("source_type"), F.col("page_id").alias("seq"),
    )
    return EV.deduped(p).select("claim_id", "url", "snippet", "title", "decisive", "seq", "copies")


def page_text(spark, d):
    return readers.link_packets(_t(spark, d, "pages")).select("url", F.length("text").alias("n"), F.sha1("text").alias("digest"))


def message_route(spark, d):
    rows = _t(spark, d, "pages").select(F.col("page_id").alias("key"), F.concat(F.lit("see "), F.col("url")).alias("text")).unionByName(_t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text"))
    return rows.select("key", route(F.col("text")).alias("route"), first_url(F.col("text")).alias("first_url"))


def route(t: Column) -> Column:
    """empty, link (an address and less than five other words) or text."""
    other = F.size(F.filter(text.tokens(F.coalesce(t, F.lit(""))), lambda w: ~F.lower(w).rlike(r"^(?:https?://|www\.)")))
    return F.when(F.trim(F.coalesce(t, F.lit(""))) == "", "empty").when(t.rlike(r"https?://|www\.") & (other < 5), "link").otherwise("text")


def first_url(t: Column) -> Column:
    """The first address, without punctuation around; www. gets https."""
    w = F.transform(text.tokens(F.coalesce(t, F.lit(""))), lambda x: F.regexp_replace(x, r"""^[.,;:!?()\[\]<>"']+|[.,;:!?()\[\]<>"']+$""", ""))
    u = F.get(F.filter(w, lambda x: x.rlike(r"^(?:https?://|www\.)")), F.lit(0))
    return F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u)


def query_build(spark, d):
    c = claim_topk(spark, d).select(F.col("doc_id").cast("string").alias("claim_id"), F.col("sentence").alias("text"), "claim_type", F.when(F.col("doc_id") % 3 == 0, "hi").otherwise("en").alias("language"), F.slice(F.regexp_extract_all("sentence", F.lit("[A-Z][a-z]+"), F.lit(0)), 1, 8).alias("terms"), F.array().cast("array<string>").alias("dates"))
    return EV.build_queries(c).select("claim_id", "rank", "text", "kind", "language", F.array_join("sites", " ").alias("sites"))


def claim_overlap_topk(spark, d):
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    return EV.lexical_candidates(b, _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), k=10).select("claim_id", "item_id", "shared", "terms", "rank")


def _pairs(spark, d, once=False):
    b, docs = _t(spark, d, "benchmark"), _t(spark, d, "documents")
    found = EV.lexical_candidates(b.select(F.col("item_id").alias("claim_id"), "text"), docs.select(F.col("doc_id").alias("item_id"), "text"))
    found = found.checkpoint() if once else found
    return found.join(b.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim")), "claim_id").join(docs.select(F.col("doc_id").alias("item_id"), "text", "source"), "item_id")


def aboutness(spark, d):
    b, docs = _t(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text"), _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    found = EV.lexical_candidates(b, docs).select("claim_id", "item_id").checkpoint()
    # a text is read once, however many others it meets
    read = docs.join(found.select("item_id").distinct(), "item_id", "left_semi").select("item_id", EV.about_read(F.col("text")).alias("e"))
    pairs = found.join(b.select("claim_id", EV.about_read(F.col("text")).alias("c")), "claim_id").join(read, "item_id")
    return pairs.select("claim_id", "item_id", EV.about_of(F.col("c"), F.col("e")).alias("a")).select("claim_id", "item_id", "a.answer", F.size("a.shared").alias("shared"), F.size("a.claim_only").alias("claim_only"), F.size("a.evidence_only").alias("evidence_only"))


def decisive_flag(spark, d):
    k = F.col("item_id")
    p = _pairs(spark, d).withColumns({"about": EV.about_any(F.col("claim"), F.col("text")), "source_type": F.when(k % 3 == 0, "web").otherwise("seed_index"), "rating": F.when(k % 2 == 0, "false").otherwise("true"), "source_weight": F.when(k % 5 == 0, 0.5).otherwise(F.lit(1.0))})
    return p.select("claim_id", "item_id", EV.is_decisive().alias("decisive"))


def candidate_rank_cap(spark, d):
    k = F.col("item_id")
    p = _pairs(spark, d).select("claim_id", F.format_string("ev_%012d", k).alias("id"), (k % 4 == 0).alias("decisive"), F.when(k % 5 == 0, 0.5).otherwise(F.lit(1.0)).alias("source_weight"), F.col("shared").cast("double").alias("score"), "text")
    return EV.ranked(p).select("claim_id", "id", "rank")


def ratings(spark, d):
    r = spark.createDataFrame([(x,) for x in RATINGS], "raw string")
    return r.select("raw", text.rating_group(F.col("raw")).alias("rating"), text.rating_stance(F.col("raw")).alias("stance"))


def cosine_topk(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.similar_pairs(e.where("id % 20 = 0"), e, 0.2, 3).select("left_id", "right_id", "rank", F.round("similarity", 6).alias("similarity"))


def image_index_match(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = media.index_matches(e.where("id % 20 = 0"), e, 0.35)
    return found.select(F.col("left_id").alias("image_id"), F.col("right_id").alias("entry_id"), "rank")


def stored_index_match(spark, d):
    """Every 20th vector asked of a stored index that was built of one half of the vectors and grown by the other."""
    at = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    image_index.build(e.where("id % 2 = 0"), at, cells=16)
    image_index.append(e.where("id % 2 = 1"), at)
    return image_index.search(e.where("id % 20 = 0").select("id", F.col("embedding").alias("v")), at, 0.35).select("image_id", "entry_id", "rank")


def best_spelling_max(spark, d):
    e = _t(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select((F.col("vec_id") % 200).alias("claim_id"), F.col("vec_id").alias("spelling"), F.col("embedding").alias("v"))
    return EV.vector_candidates(asked, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 0.25, 3).select("claim_id", "item_id", F.round("score", 6).alias("score"))


def keyframe_dedupe(spark, d):
    e = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("packet_id"), F.col("vec_id").alias("frame_time"), "embedding")
    return media.keyframes(e, similar=0.2).select("packet_id", "frame_time")


def _mentions(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("packet_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 5).cast("string").alias("entity_id"))


def shares_entity(spark, d):
    return graph.shares_entity(_mentions(spark, d)).groupBy("packet_id").agg(F.count("*").alias("links"), F.min("src").alias("first"), F.max("dst").alias("last"))


def _event_nodes(spark, d):
    e = _t(spark, d, "events")
    return e.select((F.col("user_id") % 10).alias("packet_id"), F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.lit("claim").alias("kind"), F.create_map(F.col("event_type"), F.col("value").cast("decimal(12,2)").cast("string")).alias("attrs"), F.col("event_id").alias("seq"))


def node_upsert(spark, d):
    n = graph.upsert_nodes(_event_nodes(spark, d), "seq")
    return n.select("id", "kind", F.explode("attrs").alias("name", "value"))


def graph_round_trip(spark, d):
    n = graph.upsert_nodes(_event_nodes(spark, d), "seq")
    e = _t(spark, d, "events").select((F.col("user_id") % 10).alias("packet_id"), F.concat(F.lit("u"), F.col("user_id")).alias("src"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("dst"), F.upper("event_type").alias("type"), F.lit("").alias("via"), F.create_map(F.lit("n"), F.lit("1")).alias("attrs"))
    back = graph.from_json(graph.to_json(n, graph.upsert_edges(e)))
    return graph.node_counts(back[0]).unionByName(back[1].groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")))


def _stance_log(spark, d):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "supports").when(F.col("event_type") == "error", "refutes").when(F.col("event_type") == "click", "neutral").when(F.col("event_type") == "purchase", "supports")
    return _t(spark, d, "events").select(
        F.col("user_id").alias("claim_id"), (k % 97).alias("evidence_id"), k.alias("id"), k.alias("seq"), kind.alias("stance"), ((k % 11) / F.lit(10.0)).alias("score"), ((k % 4) * F.lit(0.25)).alias("weight"),
        (k % 13 == 0).alias("decisive"), (k % 3 == 0).alias("demo"), F.when(k % 2 == 0, "false").otherwise("misleading").alias("rating"),
    )


def stance_replace(spark, d):
    return graph.replaced_stances(_stance_log(spark, d)).select("claim_id", "evidence_id", "seq", "stance")


def passage_stances(spark, d):
    """Documents about benchmark items: their passages ranked, and scored against the item in batches."""
    p = _pairs(spark, d, once=True)
    none = lambda t="string": F.lit(None).cast(t)
    evidence = p.select("claim_id", F.col("item_id").alias("id"), none().alias("title"), none().alias("snippet"), "text", none().alias("rating"), none().alias("rating_raw"), none().alias("about"))
    judged = stance.judged(evidence, _t(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text"))
    return judged.select("claim_id", "id", "stance", "stance_score", "method", "relevance", F.sha1(F.coalesce("best_passage", F.lit(""))).alias("best"))


def stance_totals(spark, d):
    return verdict.totals(_stance_log(spark, d))


def passage_vote(spark, d):
    v = _stance_log(spark, d).where("stance IS NOT NULL").withColumn("pos", F.col("seq"))
    return stance.strongest(v, ["claim_id", "evidence_id"]).withColumn("pos", F.coalesce("pos", F.lit(-1)).cast("long"))


def _event_claims(spark, d):
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("claim_id")).agg(F.count("*").alias("n")).select("claim_id", (F.col("claim_id") % 25).alias("packet_id"), (F.col("n") % 3 != 0).alias("check_worthy"), ((F.col("claim_id") % 10) / F.lit(10.0)).alias("confidence"))


def evidence_order(spark, d):
    return graph.evidence_order(_stance_log(spark, d)).select("claim_id", "id", "rank")


def duplicate_links(spark, d):
    """Line items as duplicates of their orders, each seen on the day it was shipped."""
    nodes = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("first_seen"))
    return graph.with_duplicates(nodes, _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("first_seen")))


def oldest_matches(spark, d):
    """Each customer's orders as matches of one image; of every fifth the day is unknown."""
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("day"))
    return media.oldest_first(rows, "o_custkey", "day", "o_orderkey")


def message_limit(spark, d):
    """Texts as messages of at most 280 characters: the limit is the feature."""
    cut = text.at_most(F.col("text"), 280)
    return _t(spark, d, "documents").select("doc_id", F.length(cut).alias("n_kept"), F.sha2(cut, 256).alias("kept_sha256"))


def image_urls(spark, d):
    """Pages' addresses as those of images, given in one of four places."""
    k = F.col("page_id") % 5
    given = lambda n: F.when(k == n, F.col("url"))
    path = F.when(k == 3, F.col("url")).when(k == 4, F.lit("/tmp/local.png"))
    return _t(spark, d, "pages").select("page_id", urls.image_url(given(0), given(1), given(2), path).alias("image_url"))


def stance_aliases(spark, d):
    """Event types as stances in singular, plural and capitals, or missing."""
    t = F.col("event_type")
    word = F.when(t == "view", " Support").when(t == "click", "refutes").when(t == "error", "REFUTE ").when(t == "purchase", "supports")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", text.stance_alias(word).alias("stance"))


def open_claims(spark, d):
    st = _stance_log(spark, d).where("weight > 0.6")
    return graph.open_claims(_event_claims(spark, d), st).select("claim_id", "packet_id")


def escalation(spark, d):
    st = _stance_log(spark, d).where("weight > 0.6")
    tried = _event_claims(spark, d).where("claim_id % 6 = 0")
    return agents.escalated(_event_claims(spark, d), st, tried).select("claim_id", "packet_id", "rank")


def _verdicts(spark, d):
    st = _stance_log(spark, d).withColumn("decisive", F.col("seq") % 59 == 0)
    claims = _event_claims(spark, d)
    return verdict.for_claims(claims.select("packet_id", "claim_id"), st, claims.where("claim_id % 17 = 0"), claims.where("claim_id % 19 = 0"))


def claim_verdict(spark, d):
    return _verdicts(spark, d).select("packet_id", "claim_id", "label", "rule", F.round("confidence", 4).alias("confidence"))


def packet_verdict(spark, d):
    return verdict.roll_up(_verdicts(spark, d).withColumn("confidence", F.round("confidence", 4)))


def recycled_images(spark, d):
    li = _t(spark, d, "lineitem")
    images = li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("packet_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image_id"), (F.col("l_quantity") > 25).alias("date_mismatch"))
    claims = li.select(F.col("l_orderkey").alias("packet_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"))
    links = li.where("l_linenumber <= 2 AND l_partkey % 2 = 0").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image_id"))
    return verdict.recycled(claims, links, images)


def _dated(spark, d):
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    seen = graph.first_seen(li.select(F.col("l_orderkey").alias("image_id"), F.to_date("l_shipdate").alias("day")))
    return o.select(F.col("o_orderkey").alias("image_id"), F.to_date("o_orderdate").alias("claimed")).join(seen, "image_id")


def date_mismatch(spark, d):
    return graph.date_mismatch(_dated(spark, d))


def timeline(spark, d):
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    label = lambda c: F.date_format(c, "yyyy-MM-dd")
    one = lambda df, key, day, node: df.select(F.col(key).alias("packet_id"), F.to_date(day).alias("day"), node.cast("string").alias("node"), label(day).alias("label"))
    ship = one(li, "l_orderkey", "l_shipdate", F.col("l_linenumber"))
    t = graph.timeline(one(o, "o_orderkey", "o_orderdate", F.lit("claim")), ship, one(li.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("day")), "l_orderkey", "day", F.lit("image")), one(o, "o_orderkey", "o_orderdate", F.lit("packet")))
    return t.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _records(spark, d):
    worthy = _scored(spark, d).groupBy("doc_id", "lang", "source").agg(F.bool_or("check_worthy").alias("w"), F.count_if(F.col("points") >= 600).alias("k"))
    k = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in V.SEVERITY])
    return _t(spark, d, "labels").join(worthy, "doc_id").select(
        k.cast("string").alias("id"), F.col("lang").alias("language"), F.col("source").alias("category"), F.get(names, (F.col("k") % 5).cast("int")).alias("verdict"), F.get(names, (k % 5).cast("int")).alias("expected_verdict"),
        F.col("w").alias("check_worthy"), (F.col("quality") == 1).alias("expected_check_worthy"), F.when(k % 3 == 0, k.cast("string")).alias("expected_seed_id"),
        F.when(k % 4 != 0, F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((F.floor(k / 2) * 2).cast("string")))).alias("retrieved_seed_ids"), (k % 3 == 0).alias("in_corpus"),
    )


def _checked_corpus(spark, d):
    """The benchmark as a corpus of rated fact-checks."""
    k = F.col("item_id")
    return _t(spark, d, "benchmark").select("item_id", "text", F.when(k % 3 == 0, "False").when(k % 3 == 1, "Misleading").otherwise("True").alias("rating_raw"), F.concat(F.lit("https://check.example.org/"), k.cast("string")).alias("url"), F.lit("Checkers").alias("publisher"))


def _checkers(spark):
    return spark.createDataFrame([("check.example.org", "factchecker")], "entry string, tier string")


def _labelled_cases(spark, d):
    """Labelled documents as cases. One that repeats a long sentence of a benchmark item should find that item, and get
    its rating's verdict; any other is unverified. Those of good quality should have something to check."""
    key = text.normalize(F.col("sentence"))
    items = C.sentence_rows(_t(spark, d, "benchmark"), ["item_id"]).where("length(sentence) >= 40").select("item_id", key.alias("key"))
    labelled = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left_semi")
    target = C.sentence_rows(labelled, ["doc_id"]).select("doc_id", key.alias("key")).join(items, "key").groupBy("doc_id").agg(F.min("item_id").alias("item"))
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").join(target, "doc_id", "left")
    verdict_of = F.when(F.col("item") % 3 == 0, "false").when(F.col("item") % 3 == 1, "misleading").when(F.col("item") % 3 == 2, "true").otherwise("unverified")
    expect = F.struct(verdict_of.alias("verdict"), (F.col("quality") == 1).alias("check_worthy"), F.col("item").cast("string").alias("retrieves"))
    return rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("language"), F.col("source").alias("category"), expect.alias("expect"), F.col("item").isNotNull().alias("in_corpus"))


def _engine_records(spark, d, modes=("claims", "retrieval", "full")):
    """Records of the engine itself over the labelled documents, flags by patterns alone."""
    sources = lifecycle.Sources(tables={"seed_index": lifecycle.seed_index(_checked_corpus(spark, d))})
    return evaluate.run(_labelled_cases(spark, d), TODAY, sources, _checkers(spark), modes, plain=True, languages=("en", "fr", "de", "es"))[0]


def evaluation_records(spark, d):
    r = _engine_records(spark, d)
    return r.select("id", "mode", "expected_verdict", "verdict", "confidence", "check_worthy", "n_claims", F.array_join("retrieved_seed_ids", ",").alias("retrieved"), F.size("stage_errors").alias("errors"))


def second_round(spark, d):
    """Labelled documents checked against false and misleading items; those still open are asked of the true ones."""
    corpus = _checked_corpus(spark, d)
    first = lifecycle.Sources(tables={"seed_index": lifecycle.seed_index(corpus.where("rating_raw <> 'True'"))})
    reserve = lifecycle.Sources(tables={"seed_index": lifecycle.seed_index(corpus.where("rating_raw = 'True'"))})
    packets = readers.text_packets(_labelled_cases(spark, d).where("text <> ''"))
    done = lifecycle.run(packets, TODAY, first, _checkers(spark), plain=True)
    return lifecycle.second_round(done, reserve, _checkers(spark))[1]


def evaluation_modes(spark, d):
    """What each mode measures of the same cases."""
    m = _engine_records(spark, d).groupBy("mode").agg(*evaluation.measures())
    return m.select("mode", "n", "n_verdicts", "correct", "false_accusations", "missed", "abstained", "tp", "fp", "fn", "tn", "targeted", "hits", "untargeted", "strays")


def confusion(spark, d):
    return evaluation.confusion(_engine_records(spark, d, ("full",)))


def evaluation_summary(spark, d):
    return evaluation.summary(_engine_records(spark, d, ("full",))).select("block", "value", "n", "correct", "false_accusations", "missed", "abstained", "tp", "fp", "fn", "tn", "targeted", "hits", "untargeted", "strays", F.round("f1", 6).alias("f1"))


def evaluation_gate(spark, d):
    return evaluation.gate(evaluation.summary(_engine_records(spark, d, ("full",))), {"accuracy": 0.9}, {"false_accusations": 0}).select("passed", F.array_join("reasons", ";").alias("reasons"))


def compare_runs(spark, d):
    a = _records(spark, d)
    b = a.withColumn("verdict", F.when(F.col("id").cast("long") % 2 == 0, F.col("expected_verdict")).otherwise(F.col("verdict")))
    return evaluation.compare(a, b).groupBy("change").agg(F.count("*").alias("n"))


def chat_reply(spark, d):
    c = _t(spark, d, "conversations")
    r = sinks.reply(F.lit("Be careful."), F.col("text"), F.concat(F.lit("It was said by the "), F.col("role")), F.array(F.col("role"), F.lit("second")), F.col("turn").cast("int"), F.col("conv_id") % 2 == 0)
    return c.select("conv_id", "turn", r.alias("reply"))


def request_check(spark, d):
    c = _t(spark, d, "documents").select("doc_id", "text", F.octet_length("text").alias("bytes"))
    return sinks.accepted(c, 5000, 30_000).select("doc_id", "refused")


def event_tumbling(spark, d):
    return ingest.tumbling(_t(spark, d, "events")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


def event_sliding(spark, d):
    return ingest.sliding(_t(spark, d, "events"))


def event_sessions(spark, d):
    return ingest.sessions(_t(spark, d, "events"), "6 hours")


def stream_merge(spark, d):
    """Events as a stream of files, merged by user: the latest event of each."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = ingest.stream(spark, f"{d}/events*.parquet", schema)
    q = ingest.merged(source, f"{at}/table", "user_id", ["event_id"], f"{at}/log")
    q.awaitTermination()
    return ingest.current(spark, f"{at}/table", "user_id", ["event_id"]).select("user_id", "event_id", "event_type")


def check_messages(spark, d):
    """Users' turns as messages against the benchmark as a corpus of fact-checks."""
    packets = readers.text_packets(_t(spark, d, "conversations").where("role = 'user'")).dropDuplicates(["packet_id"])
    return lifecycle.check(packets, _checked_corpus(spark, d), _checkers(spark), TODAY)[1].select("packet_id", "label", F.round("confidence", 4).alias("confidence"), "n_claims")


def first_words(asked: list[dict]) -> list[dict]:
    """A source that has a page for every text."""
    return [{"claim_id": q["claim_id"], "url": f"https://web.example.org/{len(q['text'])}", "title": q["text"][:40], "snippet": q["text"]} for q in asked]


def short_only(asked: list[dict]) -> list[dict]:
    """A source that fails on a batch with a text beyond 400 characters."""
    if any(len(q["text"]) > 400 for q in asked):
        raise ValueError("a text is too long")
    return [{"claim_id": q["claim_id"], "url": "https://check.example.org/none", "title": "reviewed", "rating_raw": "False"} for q in asked]


def source_fanout(spark, d):
    """Users' turns asked of three sources, one of which fails on some batches: what each claim got of each."""
    t = _t(spark, d, "conversations").where("role = 'user' AND trim(text) <> ''").select(F.concat_ws("-", "conv_id", "turn").alias("claim_id"), "text")
    corpus = _checked_corpus(spark, d)
    found, failed = fanout.collect(t, t.withColumn("rank", F.lit(1)), {"web": first_words, "factcheck": short_only}, {"seed_index": lifecycle.seed_index(corpus)}, batch=16, tries=2)
    a = found.groupBy("source", "claim_id").agg(F.count("*").alias("candidates"), F.lit(0).alias("tries"))
    b = failed.select("source", F.explode("claim_ids").alias("claim_id"), F.lit(0).cast("long").alias("candidates"), "tries")
    return a.unionByName(b)


def model_claim_rows(spark, d):
    """Events as a language model's answers: whole, cut off, with numbers for text, and with fields of other kinds."""
    t, v = F.col("event_type"), F.col("value").cast("string")
    k = F.get_json_object("props", "$.k")
    claim = lambda *fields: F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    text_ = F.concat(F.lit('"text":" '), t, F.lit(" of "), v, F.lit(' "'))
    entity = F.concat(F.lit('"entities":[{"text":" '), v, F.lit('","label":"NUMBER"},{"text":"x","label":"ANIMAL"},{"text":" ","label":"ORG"},7]'))
    answer = lambda *claims: F.concat(F.lit('{"claims":['), F.concat_ws(",", *claims), F.lit("]}"))
    a = (
        F.when(t == "view", answer(claim(text_, F.concat(F.lit('"confidence":'), k, F.lit("e-1")), F.lit('"claim_type":"event"')), claim(text_, F.lit('"confidence":true'))))
        .when(t == "click", answer(claim(text_, F.concat(F.lit('"confidence":"0.'), k, F.lit('"')), F.lit('"claim_type":"click"'), entity)))
        .when(t == "error", F.lit('{"claims":[{"text":"cut off'))
        .when(t == "purchase", answer(claim(F.concat(F.lit('"text":'), v)), F.lit("null"), claim(text_, F.lit('"confidence":[1]'), F.lit('"claim_type":"money"'), F.lit('"attributed_to":"shop","time":""'), entity)))
        .otherwise(answer(claim(F.lit('"text":"  "'))))
    )
    rows = _t(spark, d, "events").select("event_id", F.posexplode(model_claims.claims_of(a)).alias("n", "c"))
    return rows.select("event_id", "n", "c.text", "c.claim_type", "c.confidence", "c.attributed_to", F.col("c.time").alias("said"), F.array_join(F.transform("c.entities", lambda e: F.concat(e["label"], F.lit(":"), e["text"])), ";").alias("entities"))


QUERIES = {f.__name__: f for f in (
    clean_text, sentences, sentence_stats, sentence_offsets, passages, body_join, claim_ids, packet_ids, top_terms, language_tag, fold_spelling, entity_scan, time_refs, feature_flags, checkworthy_score, claim_topk,
    priority_topk, claim_dedupe, canonical_url, source_tier, page_dedupe, page_text, message_route, query_build, claim_overlap_topk, aboutness, decisive_flag, candidate_rank_cap, ratings, cosine_topk,
    image_index_match, best_spelling_max, keyframe_dedupe, shares_entity, node_upsert, graph_round_trip, stance_replace, stance_totals, passage_vote, evidence_order, duplicate_links, oldest_matches, message_limit, image_urls, stance_aliases, open_claims, escalation, claim_verdict, packet_verdict,
    recycled_images, date_mismatch, timeline, confusion, evaluation_summary, evaluation_gate, compare_runs, chat_reply, request_check, event_tumbling, event_sliding, event_sessions, stream_merge, check_messages,
    hinglish_rewrites, stored_index_match, second_round, evaluation_records, evaluation_modes, passage_stances, source_fanout, model_claim_rows,
)}
