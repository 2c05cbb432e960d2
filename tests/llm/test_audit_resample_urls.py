"""Filter audit, importance resampling and URL filter against plain Python over the smallest tables and hard rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import pytest
from claimloom.llm import filter_audit, importance_resampling, url_filter
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, part string, n long"
HARD = [
    (1, "Same text here " * 80, "a", "x", 1), (2, "Same text here " * 80, "b", "x", 1), (2, "Same text here " * 80, "b", "x", 1), (None, "Same text here " * 80, "a", "x", 1), (3, None, "a", "x", 1), (4, "", None, "x", 1),
    (5, " ".join(f"w{k}" for k in range(5000)), "a", "x", 1), (6, "ALL CAPITALS $ " * 200, None, "x", 1), (7, " ".join(f"v{k}" for k in range(250)), "b", "x", 1), (7, "other words of one id " * 10, "b", "x", 1), (8, "ümläut ÄÖÜ x1-y2_z3 " * 30, "a", "x", 1),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, None), (None, 1, 1), (7, 1, 1)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def audited(docs, labels):
    """Every order run over the rows in turn."""
    first = {}
    for d in docs:
        if d["id"] is not None:
            first[d["text"]] = min(first.get(d["text"], d["id"]), d["id"])
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for d in docs:
        t, w, f = d["text"], words(d["text"]), first.get(d["text"])
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": f is not None and (d["id"] is None or d["id"] > f)}
        rows.append((d["part"], fails, d["id"] in good, d["id"] in toxic))
    out, sums = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in alive if r[1][f]], [r for r in alive if not r[1][f]]
                out.append([part, "".join(order), step, len(kept), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1] == {x: x == f for x in "ABCDE"} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                sums[part, f] += len(gone)
                alive = kept
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("heavy", [1, 1000])
def test_audit_equals_running_every_order(spark, monkeypatch, heavy):
    monkeypatch.setattr(filter_audit, "HEAVY", heavy)
    docs, labels = spark.createDataFrame(HARD, DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failures(docs, labels))
    assert sorted(tuple(r) for r in got.select(AUDIT).collect()) == audited([{"id": r[0], "text": r[1] or "", "part": r[2] or ""} for r in HARD], LABELS)


def test_audit_of_a_table_and_of_none(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = filter_audit.audit(filter_audit.failures(docs.repartition(7), labels))
    plain = [{"id": r["doc_id"], "text": r["text"] or "", "part": r["source"] or ""} for r in docs.collect()]
    assert sorted(tuple(r) for r in got.select(AUDIT).collect()) == audited(plain, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert filter_audit.audit(filter_audit.failures(docs.limit(0), labels)).isEmpty()


def test_every_state_is_made_once_and_counts_the_rows_it_has(spark):
    rows = spark.createDataFrame([("p", a, b, c, True) for a, b, c in itertools.product([True, False, None], repeat=3)], "part string, X boolean, Y boolean, Z boolean, extra boolean")
    flags = rows.select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("X", "Y", "Z", "extra")])
    edges, seen = filter_audit.trie(flags, list("XYZ"), ["extra"])
    assert set(seen.values()) == {1} and len(seen) == 7 and edges.count() == 12
    assert {(r["state"], r["filter"]): (r["alive"], r["removed"]) for r in edges.collect()}[("XY", "Z")] == (12, 4)
    total = filter_audit.audit(rows, "XYZ", ("extra",))
    assert total.where("filter_order = 'ZYX' AND step = 3").select("kept", "removed", "redundant", "unique_fails", "extra_lost", "shapley").first() == (8, 4, 5, 4, 4, 2 * 9 + 6 + 6 + 2 * 4)


def resampled(docs, target, share=25, least=20):
    def feats(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        return w, [zlib.crc32(x) % 10000 for x in w] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(w, w[1:])]

    rows = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for i, w, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    ranked = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    ranks = {id(r): k for k, r in enumerate(ranked[: share * len(ranked) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


def check_resampled(spark, docs, target, **kw):
    got = importance_resampling.resample(docs, target, **kw)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], **{"least": kw.get("least_words", 20), "share": kw.get("share", 25)})


def test_resampling_equals_plain_python(spark, monkeypatch):
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    check_resampled(spark, docs, target)
    monkeypatch.setattr(importance_resampling, "GROUP_ROWS", 1)  # many groups a part
    check_resampled(spark, docs.repartition(5), target.repartition(3), share=60)


def test_resampling_of_hard_rows(spark):
    target = spark.createDataFrame([(1, "words of one"), (2, None), (3, "ümläut")], "item_id long, text string")
    docs = spark.createDataFrame(HARD, DOCS)
    check_resampled(spark, docs, target, share=50)
    check_resampled(spark, docs, target.limit(0), share=100, least_words=0)
    check_resampled(spark, docs.limit(0), target)


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = ("Über x1 -- a b c" + " word" * 50 + " " * 40 + "end").encode()
    whole = Counter(x for sums in importance_resampling.features(text, 3) for x in sums)
    for piece in (1, 7, 30):
        monkeypatch.setattr(importance_resampling, "PIECE", piece)
        assert Counter(x for sums in importance_resampling.features(text, 3) for x in sums) == whole
    w = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text))
    assert whole == Counter(zlib.crc32(b" ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("b.org", "", "block"), ("b.org", "/a", "allow"), ("b.org", "/a", "block")]
URLS = [
    None, "", "x", "http://www.example.com/en/x?y", "http://a.b.example.com/en/", "HTTP://EXAMPLE.com/EN/", "http://com", "http://com/", "a://net/es/://", "://net/fr/", "http://notcom/", "http://b.org", "https://x.b.org/ab#c",
    "http://spam.org/a/", "https://www.spam.org/a?utm_source=f", "http://spam.org/b", "http://" + "." * 3000 + "com/" + "a" * 3000, "http://h.com?x=/en/", "http://exämple.net/fr/ö",
]
LISTED = ["http://spam.org/a", "https://example.com/en/", None, "", "http://spam.org/a"]


def judged(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best and best[3], best[2] if best else "block" if listed(url) else "allow"


@pytest.mark.parametrize("blocks", [1, 1 << 18])  # one block lets nearly everything pass: the join alone decides
def test_urls_equal_plain_rules(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
    rows = [(k, u, "r", "v") for k, u in enumerate(URLS * 2)] + [(0, None, "r", "v"), (None, URLS[3], "r", "v"), (3, URLS[3], "r", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string").repartition(3)
    rules, listed = spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in LISTED], "url string")
    got = url_filter.judge(pages, rules, listed)
    on_list = lambda u: u in ("http://spam.org/a/", "https://www.spam.org/a?utm_source=f")
    assert Counter(tuple(r) for r in got.collect()) == Counter((k, *judged(u, RULES, on_list)) for k, u, *_ in rows)
    assert url_filter.judge(pages.limit(0), rules, listed).isEmpty()
    assert {tuple(r) for r in url_filter.judge(pages, rules.limit(0), listed.limit(0)).select("rule", "verdict").collect()} == {(None, "allow")}


def test_filter_has_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = 20_000 * url_filter.BITS_A_KEY // 256
    words = url_filter.bloom(keys, blocks).scalar()
    seen = spark.range(40_000).select("id", url_filter.possible(F.concat(F.lit("k"), F.col("id")), words, blocks).alias("may"))
    counts = {r["listed"]: r["n"] for r in seen.where("may").groupBy((F.col("id") < 20_000).alias("listed")).agg(F.count("*").alias("n")).collect()}
    assert counts[True] == 20_000 and counts.get(False, 0) < 200


def test_a_url_without_listed_keys_meets_no_list(spark):
    """Only what the filter passes reaches the join: one row stands for each other URL."""
    pages = spark.createDataFrame([(k, f"http://h{k}.org/p") for k in range(100)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(RULES[:5], "host string, path string, verdict string"), spark.createDataFrame([("http://h5.org/p",)], "url string"))
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == {5} and got.count() == 100
