"""The registered queries of this subpackage, with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import byte_bpe, filter_audit, importance_resampling, language_model, line_dedup, merkle, multi_index, ngram_join, secrets_crf, source_mixing, token_counts, toxicity, url_filter
from claimloom.llm.frames import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), pattern())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir)).withColumnRenamed("component", "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), pattern())


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = line_dedup.kept(line_dedup.build(docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets_crf.scan(docs, secrets_crf.train(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Rules by host and path, longest first to decide.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The tables hold no list of URLs: what the table has of this host is listed.
SPAM_HOST = "spam-farm.example.org"


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = url_filter.host(F.col("url"))
    listed = pages.where((host == SPAM_HOST) | host.endswith(f".{SPAM_HOST}")).select("url")
    return url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), listed)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_join, op3_source_mixing, op4_byte_bpe, op5_multi_index, op6_line_dedup, op7_secret_scan, op8_toxicity, op9_lm_scoring, op10_merkle_fingerprints, op11_filter_audit, op12_importance_resampling, op13_url_filter)}

_TREE = """list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
    list_transform(regexp_extract_all(p, '[^.!?]{{1,200}}[.!?]*|[.!?]+'), lambda x: sha256(x))))"""
_ROOT = """sha256('r' || array_to_string(list_transform({t}, lambda s: sha256('s' || array_to_string(list_transform(s, lambda p:
    sha256('p' || array_to_string(p, ''))), ''))), ''))"""
_SHOWN = """array_to_string(list_transform({t}, lambda s: array_to_string(list_transform(s, lambda p:
    array_to_string(list_transform(p, lambda x: x[1:12]), '')), ',')), ';')"""
_SET = "list_distinct(list_transform(flatten(flatten({t})), lambda x: x[1:12]))"
_NEAR = """CASE WHEN {a}_root = {b}_root THEN 1.0::DOUBLE WHEN greatest(len({a}_set), len({b}_set)) = 0 THEN 0.0
    ELSE len(list_intersect({a}_set, {b}_set))::DOUBLE / greatest(len({a}_set), len({b}_set)) END"""


def _parts(name: str) -> str:
    return f"{_ROOT.format(t=name)} AS {name}_root, {_SHOWN.format(t=name)} AS {name}_shown, {_SET.format(t=name)} AS {name}_set"


ORACLE_SQL = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN []::VARCHAR[] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
      ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) END AS g FROM w),
c AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM s),
t AS (SELECT doc_id, n, unnest(g) AS tok FROM c),
f AS (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1),
u AS (SELECT doc_id, n, tok FROM t JOIN f USING (tok)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.tok = b.tok AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT doc_id AS id, doc_id AS m FROM c UNION SELECT e.y AS id, r.m FROM r JOIN e ON e.x = r.id)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, min(r.m) AS component_id FROM c JOIN r ON r.id = c.doc_id GROUP BY 1, 2""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op10_merkle_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER o AS nt, first_value(coalesce(text, '')) OVER o AS ft
           FROM documents WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT doc_id, t, coalesce(nt, ft) AS n, length(t) AS k FROM d),
x AS (SELECT doc_id, t, n, k, substr(t, 1, k - k // 2) || substr(n, 1, k // 2) AS ed FROM e),
trees AS (SELECT doc_id, k, ed, {_TREE.format(t="t")} AS a, {_TREE.format(t="ed")} AS b, {_TREE.format(t="n")} AS c FROM x),
parts AS (SELECT doc_id, k, ed, {_parts("a")}, {_parts("b")}, {_parts("c")} FROM trees)
SELECT doc_id, k::BIGINT AS n_chars, sha256(ed) AS edited_sha256, a_root || ':' || a_shown AS fingerprint, b_root || ':' || b_shown AS edited_fingerprint,
       {_NEAR.format(a="a", b="b")} AS near_edited, {_NEAR.format(a="a", b="c")} AS near_next
FROM parts""",
    "op11_filter_audit": r"""
WITH RECURSIVE l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (first IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first))::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
      list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < step THEN 1 << (instr('ABCDE', filter_order[i]) - 1) ELSE 0 END))::INT AS before
      FROM o, unnest([1, 2, 3, 4, 5]) AS v(step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step::INT AS step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
      sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
      sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r""",
    "op13_url_filter": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(h, p, verdict)),
b AS (SELECT page_id, host, path, (SELECT max_by({'rule': h || p, 'verdict': r.verdict}, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org') THEN 'block' ELSE 'allow' END) AS verdict FROM b""",
}
