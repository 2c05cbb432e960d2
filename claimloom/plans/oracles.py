"""DuckDB SQL for the queries of ``catalogue`` that SQL can express, written apart from the plans; fixed values are shared."""

from __future__ import annotations

from claimloom.functions import vocab as V
from claimloom.operators.claims import FEATURES, PLAIN
from claimloom.plans.catalogue import RATINGS, TIERS

W = r"\p{L}\p{N}_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, t: str) -> str:
    return template.replace("{t}", t)


def words(text: str) -> str:
    return "[" + ", ".join(q(w) for w in text.split()) + "]"


_HELD = q(rf"(?i)((?:^|[^{W}])(?:{V.ABBREVIATIONS})\.)\s+")
_CLEAN = r"regexp_replace(regexp_replace(replace(coalesce({t}, ''), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _pieces(t: str) -> str:
    """List of the sentences of a cleaned text."""
    held = rf"regexp_replace(regexp_replace({t}, {_HELD}, '\1' || chr(1), 'g'), {_HELD}, '\1' || chr(1), 'g')"
    cut = rf"regexp_replace(regexp_replace({held}, '([.!?।])\s+', '\1' || chr(2), 'g'), '\n+', chr(2), 'g')"
    return rf"list_filter(list_transform(string_split({cut}, chr(2)), lambda x: replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(1), ' ')), lambda x: x <> '')"


_SQUEEZE = r"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
_TOKENS = r"len(list_filter(string_split_regex({t}, '\s+'), lambda x: x <> ''))"
_SENT = f"""sent AS (SELECT doc_id, lang, source, sentence FROM (SELECT doc_id, lang, source, {fill(_SQUEEZE, "u")} AS sentence FROM
  (SELECT doc_id, lang, source, unnest({_pieces(fill(_CLEAN, "text"))}) AS u FROM documents)) WHERE sentence <> '')"""
_FLAGS = ", ".join(f"regexp_matches(sentence, {q(p)}) AS f_{n}" for n, p in [*FEATURES.items(), *PLAIN.items()])
_FLAGGED = f"{_SENT}, flag AS (SELECT *, {_FLAGS}, {fill(_TOKENS, 'sentence')} AS tokens FROM sent)"


def _points() -> str:
    topical = "(f_policy OR f_health OR f_event)"
    firm = f"(f_attribution OR {topical} OR f_chain_offer OR f_quantity OR f_urgency OR f_contact OR f_url)"
    up = [f"CASE WHEN {topical if k == 'topical' else 'f_' + k} THEN {v} ELSE 0 END" for k, v in V.GAINS.items()]
    cond = {"question": "f_question", "opinion": "f_opinion", "personal": f"(f_personal OR f_person_marked) AND NOT {firm}", "imperative_only": "f_imperative_only AND NOT (f_quantity OR f_chain_offer)"}
    down = [f"CASE WHEN {cond[k]} THEN {v} ELSE 0 END" for k, v in V.LOSSES.items()]
    return f"CASE WHEN f_greeting OR tokens < {V.LEAST_TOKENS} OR tokens > {V.MOST_TOKENS} THEN 0 ELSE greatest(0, least(1000, {V.BASE} + {' + '.join(up)} - {' - '.join(down)})) END"


_TYPE = """CASE WHEN f_chain_offer AND (f_contact OR f_imperative_only OR f_money) THEN 'chain_offer' WHEN f_health THEN 'health' WHEN f_policy THEN 'policy'
  WHEN f_attribution THEN 'attribution' WHEN f_money THEN 'money' WHEN f_percent THEN 'statistic' WHEN f_event THEN 'event' WHEN f_number AND f_has_verb THEN 'statistic'
  WHEN f_causal THEN 'causal' WHEN f_prediction THEN 'prediction' WHEN f_time_ref THEN 'event' WHEN f_chain_offer THEN 'chain_offer' ELSE 'generic' END"""
_SCORED = f"""{_FLAGGED}, pts AS (SELECT *, {_points()} AS points, {_TYPE} AS claim_type FROM flag),
scored AS (SELECT *, points / 1000.0::DOUBLE AS confidence, points >= {V.WORTHY} AS check_worthy, CASE WHEN points >= {V.WORTHY} THEN NULL WHEN f_greeting THEN 'greeting' WHEN tokens < {V.LEAST_TOKENS} THEN 'too_short'
  WHEN tokens > {V.MOST_TOKENS} THEN 'too_long' WHEN f_question THEN 'question' WHEN f_opinion THEN 'opinion' WHEN f_personal THEN 'personal' WHEN f_imperative_only THEN 'imperative_only' ELSE 'low_signal' END AS drop_reason FROM pts)"""

_NORM = rf"trim(regexp_replace(regexp_replace(lower({{t}}), '[^{W}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _ends(w: str, suffix: str, keep: int) -> str:
    return f"({w} LIKE '%{suffix}' AND length({w}) - {len(suffix)} >= {keep})"


def _left(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


_S1 = f"CASE WHEN {_ends('w', 'ies', 3)} THEN {_left('w', 3)} || 'y' WHEN {_ends('w', 'sses', 3)} THEN {_left('w', 2)} WHEN {_ends('w', 's', 3)} AND NOT w LIKE '%ss' THEN {_left('w', 1)} ELSE w END"
_S2 = f"CASE WHEN {_ends('w', 'ing', 4)} THEN {_left('w', 3)} WHEN {_ends('w', 'ed', 4)} THEN {_left('w', 2)} ELSE w END"
_S3 = f"CASE WHEN {_ends('w', 'e', 4)} THEN {_left('w', 1)} ELSE w END"


def _terms(t: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[ऀ-ॣ०-ॿ]+|[{W}]+'), lambda w: length(w) > 1 AND NOT list_contains({words(V.STOP)}, w))"
    return f"list_distinct(list_transform(list_transform(list_transform({kept}, lambda w: {_S1}), lambda w: {_S2}), lambda w: {_S3}))"


def _overlap_words(t: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[{W}]+'), lambda w: length(w) > 1 AND NOT list_contains({words(V.OVERLAP_STOP)}, w)))"


_PAIRS = f"""bw AS (SELECT item_id AS claim_id, text AS claim, {_overlap_words("text")} AS l FROM benchmark),
b1 AS (SELECT claim_id, claim, len(l) AS terms, unnest(l) AS w FROM bw), d1 AS (SELECT doc_id AS item_id, unnest({_overlap_words("text")}) AS w FROM documents),
hit AS (SELECT claim_id, item_id, terms, count(*) AS shared FROM b1 JOIN d1 USING (w) GROUP BY ALL HAVING count(*)::DOUBLE / terms >= {V.DECISIVE_OVERLAP}),
pair AS (SELECT hit.*, bw.claim, documents.text FROM hit JOIN bw USING (claim_id) JOIN documents ON doc_id = item_id)"""
_SCRIPT = "CASE WHEN regexp_matches({t}, '[ऀ-ॿ]') THEN 'deva' ELSE 'latin' END"
_ABOUT = f"""{_PAIRS}, tm AS (SELECT claim_id, item_id, claim, text, {_terms("claim")} AS a, {_terms("text")} AS b FROM pair),
ab AS (SELECT *, list_intersect(a, b) AS s, trim(claim) = '' OR trim(coalesce(text, '')) = '' OR {fill(_SCRIPT, "claim")} <> {fill(_SCRIPT, "text")} OR least(len(a), len(b)) < {V.ABOUT_LEAST_TERMS} AS unclear FROM tm),
about AS (SELECT *, CASE WHEN unclear THEN 'unclear' WHEN len(s)::DOUBLE / least(len(a), len(b)) >= {V.ABOUT_FLOOR} THEN 'about' ELSE 'not_about' END AS answer FROM ab)"""


def _hits(t: str) -> str:
    doubled = rf"regexp_replace({t}, '([^{W}])', '\1\1', 'g')"
    return f"len(regexp_extract_all({doubled}, {q(f'(?i)(?:^|[^{W}])(?:{V.HINGLISH})(?:$|[^{W}])')}))"


_STANCE = """st AS (SELECT user_id AS claim_id, event_id % 97 AS evidence_id, event_id AS id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'supports' WHEN 'error' THEN 'refutes' WHEN 'click' THEN 'neutral' WHEN 'purchase' THEN 'supports' END AS stance,
  (event_id % 11) / 10.0::DOUBLE AS score, (event_id % 4) * 0.25::DOUBLE AS weight, event_id % 13 = 0 AS decisive, event_id % 3 = 0 AS demo,
  CASE WHEN event_id % 2 = 0 THEN 'false' ELSE 'misleading' END AS rating FROM events)"""
_CLAIMS = "cl AS (SELECT user_id AS claim_id, user_id % 25 AS packet_id, count(*) % 3 <> 0 AS check_worthy, (user_id % 10) / 10.0::DOUBLE AS confidence FROM events GROUP BY user_id)"
_WGT = "CASE WHEN weight = 0 THEN 0.5 ELSE weight END"


def _totals(source: str) -> str:
    w = f"round(score * {_WGT}, 4)"
    side = lambda s: f"round(coalesce(sum({w}) FILTER (stance = '{s}'), 0.0), 4) AS {s}"
    return f"""SELECT claim_id, {side("supports")}, {side("refutes")}, {side("neutral")}, count_if(coalesce(stance = 'supports', false))::BIGINT AS n_supports, count_if(coalesce(stance = 'refutes', false))::BIGINT AS n_refutes,
  count_if(coalesce(stance = 'neutral', false))::BIGINT AS n_neutral, count_if(stance IS NULL)::BIGINT AS n_unscored, count_if(coalesce(stance IN ('supports', 'refutes') AND decisive, false))::BIGINT AS n_decisive,
  count(*) AS n_evidence, bool_and(demo) AS demo_only FROM {source} GROUP BY claim_id"""


_VERDICT = f"""{_STANCE}, {_CLAIMS}, s7 AS (SELECT * REPLACE (seq % 59 = 0 AS decisive) FROM st), tot AS ({_totals("s7")}),
hit AS (SELECT claim_id, arg_max({{'s': stance, 'r': rating}}, {{'a': round(score * {_WGT}, 4), 'b': {_WGT}, 'c': id}}) AS h FROM s7 WHERE decisive AND stance IN ('supports', 'refutes') GROUP BY claim_id),
vd AS (SELECT packet_id, claim_id, coalesce(supports, 0) AS s, coalesce(refutes, 0) AS r, demo_only, h, claim_id % 17 = 0 AS rec, claim_id % 19 = 0 AS mis FROM cl LEFT JOIN tot USING (claim_id) LEFT JOIN hit USING (claim_id)),
rl AS (SELECT *, CASE WHEN h IS NOT NULL THEN 'decisive' WHEN rec THEN 'recycled' WHEN mis THEN 'mismatch' WHEN r >= 0.5 AND r >= 2 * s THEN 'against' WHEN s >= 0.5 AND s >= 2 * r THEN 'for' WHEN s > 0 AND r > 0 THEN 'disputed' ELSE 'unverified' END AS k FROM vd),
lb AS (SELECT *, CASE k WHEN 'decisive' THEN CASE WHEN h.r = 'misleading' THEN 'misleading' WHEN h.s = 'supports' THEN 'true' ELSE 'false' END WHEN 'recycled' THEN 'misleading' WHEN 'mismatch' THEN 'misleading' WHEN 'against' THEN 'false' WHEN 'for' THEN 'true' ELSE k END AS label,
  CASE k WHEN 'decisive' THEN 0.9 WHEN 'recycled' THEN 0.75 WHEN 'mismatch' THEN 0.6 WHEN 'against' THEN least(0.85, 0.5 + r / 4) WHEN 'for' THEN least(0.85, 0.5 + s / 4) WHEN 'disputed' THEN 0.4 ELSE 0.2 END::DOUBLE AS c FROM rl),
fin AS (SELECT packet_id, claim_id, label, CASE WHEN k IN ('against', 'for') THEN 'weighted' ELSE k END AS rule, round(CASE WHEN coalesce(demo_only, false) AND label <> 'unverified' THEN c * 0.8 ELSE c END, 4) AS confidence FROM lb)"""
_SEV = "list_position(['" + "', '".join(V.SEVERITY) + "'], label)"
_NAMES = "['" + "', '".join(V.SEVERITY) + "']"
_RECORDS = f"""{_SCORED}, wd AS (SELECT doc_id, lang, source, bool_or(check_worthy) AS w, count_if(points >= 600) AS k FROM scored GROUP BY ALL),
rec AS (SELECT doc_id, lang AS language, source AS category, {_NAMES}[(k % 5 + 1)::INT] AS verdict, {_NAMES}[(doc_id % 5 + 1)::INT] AS expected_verdict, w AS check_worthy, quality = 1 AS expected, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS target,
  CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN []::BIGINT[] ELSE [(doc_id // 2) * 2] END END AS got, doc_id % 3 = 0 AS in_corpus FROM labels JOIN wd USING (doc_id))"""
_ACC = "('false', 'misleading')"
_MEASURES = f"""count(*) AS n, count_if(coalesce(verdict = expected_verdict, false))::BIGINT AS correct, count_if(expected_verdict NOT IN {_ACC} AND verdict IN {_ACC})::BIGINT AS false_accusations, count_if(expected_verdict IN {_ACC} AND verdict NOT IN {_ACC})::BIGINT AS missed,
  count_if(verdict = 'unverified' AND expected_verdict <> 'unverified')::BIGINT AS abstained, count_if(check_worthy AND expected)::BIGINT AS tp, count_if(check_worthy AND NOT expected)::BIGINT AS fp, count_if(NOT check_worthy AND expected)::BIGINT AS fn, count_if(NOT check_worthy AND NOT expected)::BIGINT AS tn,
  count_if(got IS NOT NULL AND target IS NOT NULL)::BIGINT AS targeted, count_if(coalesce(list_contains(got, target), false))::BIGINT AS hits, count_if(got IS NOT NULL AND target IS NULL)::BIGINT AS untargeted, count_if(coalesce(len(got) > 0, false) AND target IS NULL)::BIGINT AS strays"""

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_CANON = rf"""u1 AS (SELECT page_id, url, {_HOST} AS host, regexp_replace({_PATH}, '(?i)/amp/?$|\.amp$', '') AS path, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(?:{V.TRACKING})$'))) AS qs FROM {{t}}),
canon AS (SELECT page_id, host AS domain, 'https://' || host || CASE WHEN length(path) > 1 AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(list_transform(qs, lambda p: CASE WHEN p LIKE '%=%' THEN p ELSE p || '=' END), '&') ELSE '' END AS url FROM u1)"""
_PAGES = fill(_CANON, "pages")
_LISTED = "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in TIERS) + ") AS l(entry, tier)"
_HTML = r"""regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<head\b.*?</head\s*>|<footer\b.*?</footer\s*>', ' ', 'g')"""
_VIS = rf"""regexp_replace(regexp_replace({_HTML}, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"""
_UNESC = f"""replace(replace(replace(replace(replace(replace({_VIS}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""
_ROUTE = rf"""CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN regexp_matches(text, 'https?://|www\.') AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '' AND NOT regexp_matches(lower(w), '^(?:https?://|www\.)'))) < 5 THEN 'link' ELSE 'text' END"""
_URLS = r"""list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda w: regexp_replace(w, '^[.,;:!?()\[\]<>"'']+|[.,;:!?()\[\]<>"'']+$', '', 'g')), lambda w: regexp_matches(w, '^(?:https?://|www\.)'))[1]"""


def _rated(groups, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(raw)), {q(p)}) THEN {q(n)}" for n, p in groups) + f" ELSE {other} END"


_LONG = r"""CASE WHEN length(x) <= 800 THEN [x] ELSE string_split(list_reduce(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''),
  lambda a, w: CASE WHEN length(regexp_extract(a, '[^\x03]*$')) + 1 + length(w) > 800 THEN a || chr(3) || w ELSE a || ' ' || w END), chr(3)) END"""
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_LI = "l_orderkey || '-' || l_linenumber"


def _reply() -> str:
    full = "'Be careful.' || chr(10) || chr(10) || 'Claim: ' || left(text, 200) || chr(10) || 'It was said by the ' || role || chr(10) || chr(10) || 'Why:' || chr(10) || '  - ' || role || chr(10) || '  - second'"
    full += " || CASE WHEN turn > 0 THEN chr(10) || chr(10) || '(' || turn || ' other claim' || CASE WHEN turn > 1 THEN 's' ELSE '' END || ' checked.)' ELSE '' END"
    full += " || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'Note: this is running on the demo evidence index, not on live fact-checks.' ELSE '' END"
    return f"CASE WHEN coalesce(text, '') = '' THEN 'Be careful.' || chr(10) || 'I couldn''t find a factual claim in this message to check.' ELSE {full} END"


def _truncated(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) <= {n} THEN {t} WHEN contains(left({t}, {n}), ' ') THEN regexp_extract(left({t}, {n}), '(?s)^(.*) ', 1) ELSE left({t}, {n}) END"


_ADDR = rf"trim(regexp_replace(regexp_replace({{t}}, '(?i)https?://\S+|www\.\S+|\S+@\S+', ' ', 'g'), '\s+', ' ', 'g'))"
_TOP1 = f"{_SCORED}, one AS (SELECT doc_id, sentence, max(confidence) AS confidence, min(claim_type) AS claim_type, bool_or(check_worthy) AS check_worthy FROM scored GROUP BY ALL), top1 AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, sentence) = 1)"
_WORDS_OF = "CASE claim_type " + " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in V.ROUTES.items()) + " END"
_HINDI_OF = "CASE claim_type " + " ".join(f"WHEN {q(k)} THEN {q(v[2])}" for k, v in V.ROUTES.items()) + " END"
_SITES_OF = "CASE claim_type " + " ".join(f"WHEN {q(k)} THEN {q(' '.join(dict.fromkeys(s for g in v[1] for s in V.SITES[g])))}" for k, v in V.ROUTES.items()) + " END"
_QUERY_TERMS = "list_transform(list_filter(list_zip(t8, range(1, len(t8) + 1)), lambda z: list_position(list_transform(t8, lambda y: lower(y)), lower(z[1])) = z[2]), lambda z: z[1])"


def _sentences_of(table: str, keys: str, name: str, where: str = "true") -> str:
    """Sentences of a table with their places, as ``name``."""
    return f"""{name} AS (SELECT {keys}, n, sentence FROM (SELECT {keys}, generate_subscripts(l, 1) - 1 AS n, {fill(_SQUEEZE, "unnest(l)")} AS sentence FROM
  (SELECT {keys}, {_pieces(fill(_CLEAN, "text"))} AS l FROM {table} WHERE {where})) WHERE sentence <> '')"""


_SET_OF = f"list_distinct(list_filter(string_split({fill(_NORM, 'sentence')}, ' '), lambda x: x <> ''))"


def _survivors(source: str, key: str, order: str) -> str:
    """Greedy near-duplicate removal of ``source`` (confidence, check_worthy), one sentence of each key after another, as ``kept``."""
    like = "len(list_intersect(k.t, r.t)) > 0 AND len(list_intersect(k.t, r.t))::DOUBLE / len(list_distinct(list_concat(k.t, r.t))) >= 0.8"
    first = f"list_position(list_transform(f.kept, lambda k: {like}), true)"
    grown = "list_append(f.kept, {'id': r.id, 't': r.t, 'c': r.confidence, 'w': r.check_worthy})"
    raised = f"list_transform(f.kept, lambda k, i: CASE WHEN i = {first} AND r.confidence > k.c THEN {{'id': k.id, 't': k.t, 'c': r.confidence, 'w': r.check_worthy}} ELSE k END)"
    return f"""rowed AS (SELECT *, {_SET_OF} AS t, row_number() OVER (ORDER BY {key}, {order}) AS id, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS step FROM {source}),
folded AS (SELECT {key}, step, [{{'id': id, 't': t, 'c': confidence, 'w': check_worthy}}] AS kept FROM rowed WHERE step = 1
  UNION ALL SELECT f.{key}, r.step, CASE WHEN {first} IS NULL OR {first} = 0 THEN {grown} ELSE {raised} END FROM folded f JOIN rowed r ON r.{key} = f.{key} AND r.step = f.step + 1),
kept AS (SELECT rowed.* EXCLUDE (confidence, check_worthy, t, step), k.c AS confidence, k.w AS check_worthy FROM
  (SELECT unnest(kept) AS k FROM folded QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY step DESC) = 1) JOIN rowed ON rowed.id = k.id)"""


_CASE_TEXTS = """cs AS (SELECT d.doc_id, lang, source, quality, coalesce(text, '') AS text, 'pkt_' || left(sha1('text|' || left(coalesce(text, ''), 500) || '|0'), 12) AS packet_id FROM labels JOIN documents d USING (doc_id)),
ps AS (SELECT packet_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source FROM cs WHERE text <> '' GROUP BY packet_id)"""
_BENCH_SENT = _sentences_of("benchmark", "item_id", "bs")
_TARGETS = f"""tg AS (SELECT doc_id, min(item_id) AS item FROM sent JOIN bs ON {fill(_NORM, 'sent.sentence')} = {fill(_NORM, 'bs.sentence')} WHERE length(bs.sentence) >= 40 GROUP BY doc_id)"""
_ITEMS = f"""it AS (SELECT item_id, text AS item_text, {_overlap_words('text')} AS iw, {_terms('text')} AS it_terms, CASE item_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'misleading' ELSE 'true' END AS rating FROM benchmark)"""
_ENGINE = f"""{_SENT}, {_BENCH_SENT}, {_TARGETS}, {_CASE_TEXTS}, {_ITEMS},
{_sentences_of("ps", "packet_id", "es")}, ef AS (SELECT *, {_FLAGS}, {fill(_TOKENS, 'sentence')} AS tokens FROM es),
sc AS (SELECT packet_id, n, sentence, p / 1000.0::DOUBLE AS confidence, p >= {V.WORTHY} AS check_worthy FROM (SELECT *, {_points()} AS p FROM ef)),
{_survivors("sc", "packet_id", "n")},
cm AS (SELECT DISTINCT packet_id, 'clm_' || left(sha1(packet_id || '|' || {fill(_NORM, 'sentence')}), 12) AS claim_id, sentence, confidence FROM kept WHERE check_worthy),
cw AS (SELECT *, {_overlap_words('sentence')} AS w, {_terms('sentence')} AS terms FROM cm),
hits AS (SELECT claim_id, packet_id, sentence, terms, item_id, it_terms, item_text, rating, len(list_intersect(w, iw))::DOUBLE / len(w) AS o FROM cw, it WHERE len(w) > 0 AND len(list_intersect(w, iw))::DOUBLE / len(w) >= 0.3),
ev AS (SELECT *, 'ev_' || left(sha1(claim_id || '|seed_index|https://check.example.org/' || item_id), 12) AS id, CASE WHEN {fill(_SCRIPT, 'sentence')} <> {fill(_SCRIPT, 'item_text')} OR least(len(terms), len(it_terms)) < {V.ABOUT_LEAST_TERMS} THEN 'unclear'
  WHEN len(list_intersect(terms, it_terms))::DOUBLE / least(len(terms), len(it_terms)) >= {V.ABOUT_FLOOR} THEN 'about' ELSE 'not_about' END AS about FROM hits QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY o DESC, item_id::VARCHAR::BIGINT) <= 3),
st AS (SELECT claim_id, sum(CASE WHEN about <> 'not_about' AND rating <> 'true' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN about <> 'not_about' AND rating = 'true' THEN 1 ELSE 0 END) AS s,
  arg_max(rating, id) FILTER (WHERE about <> 'not_about' AND rating <> 'true' AND o >= {V.DECISIVE_OVERLAP}) AS hit FROM ev GROUP BY claim_id),
vc AS (SELECT packet_id, claim_id, coalesce(r, 0) AS r, coalesce(s, 0) AS s, hit FROM cm LEFT JOIN st USING (claim_id)),
vl AS (SELECT packet_id, claim_id, CASE WHEN hit IS NOT NULL THEN hit WHEN r >= 0.5 AND r >= 2 * s THEN 'false' WHEN s >= 0.5 AND s >= 2 * r THEN 'true' WHEN s > 0 AND r > 0 THEN 'disputed' ELSE 'unverified' END AS label,
  CASE WHEN hit IS NOT NULL THEN 0.9 WHEN r >= 0.5 AND r >= 2 * s THEN least(0.85, 0.5 + r / 4.0) WHEN s >= 0.5 AND s >= 2 * r THEN least(0.85, 0.5 + s / 4.0) WHEN s > 0 AND r > 0 THEN 0.4 ELSE 0.2 END::DOUBLE AS c FROM vc),
vp AS (SELECT packet_id, arg_min({{'l': label, 'c': c}}, {{'a': {_SEV}, 'b': -c, 'i': claim_id}}) AS w, count(*) AS n_claims FROM vl GROUP BY packet_id),
vr AS (SELECT packet_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS got FROM ev GROUP BY packet_id),
er AS (SELECT cs.doc_id, lang AS language, source AS category, CASE item % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'misleading' WHEN 2 THEN 'true' ELSE 'unverified' END AS expected_verdict, coalesce(w.l, 'unverified') AS verdict, coalesce(w.c, 0.2) AS confidence,
  coalesce(n_claims, 0) AS n_claims, coalesce(n_claims, 0) > 0 AS check_worthy, quality = 1 AS expected, item::VARCHAR AS target, coalesce(got, []::VARCHAR[]) AS got, item IS NOT NULL AS in_corpus, text <> '' AS ran
  FROM cs LEFT JOIN tg USING (doc_id) LEFT JOIN vp USING (packet_id) LEFT JOIN vr USING (packet_id))"""
_ENGINE_MODES = f"""{_ENGINE}, mr AS (SELECT doc_id, mode, expected_verdict, CASE WHEN mode = 'full' AND ran THEN verdict END AS verdict, CASE WHEN mode = 'full' AND ran THEN round(confidence, 4) END AS confidence, CASE WHEN ran THEN check_worthy END AS check_worthy,
  CASE WHEN ran THEN n_claims END AS n_claims, expected, target, CASE WHEN mode <> 'claims' AND ran THEN got END AS got, (NOT ran)::INT AS errors FROM er, unnest(['claims', 'retrieval', 'full']) AS m(mode))"""


SQL: dict[str, str] = {
    "clean_text": f"SELECT doc_id, length(t)::INT AS n, sha1(t) AS digest FROM (SELECT doc_id, {fill(_CLEAN, 'text')} AS t FROM documents)",
    "sentences": f"WITH {_SENT} SELECT doc_id, sentence FROM sent",
    "sentence_stats": f"WITH {_SENT} SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS sentences, sum({fill(_TOKENS, 'sentence')})::BIGINT AS tokens FROM sent GROUP BY lang",
    "passages": f"""WITH p AS (SELECT doc_id, flatten(list_transform({_pieces(fill(_CLEAN, "text"))}, lambda x: {_LONG})) AS l FROM documents),
g AS (SELECT doc_id, l, len(l) AS n, ceil(len(l) / 3.0)::INT AS k, CASE WHEN len(l) > 3 AND len(l) % 3 = 1 THEN 1 ELSE 0 END AS lack FROM p WHERE len(l) > 0),
r AS (SELECT *, unnest(range(0, k)) AS i FROM g)
SELECT doc_id, i::INT AS pos, array_to_string(l[(i * 3 - CASE WHEN i = k - 1 THEN lack ELSE 0 END + 1):(CASE WHEN i = k - 2 THEN (i + 1) * 3 - lack WHEN i = k - 1 THEN n ELSE (i + 1) * 3 END)], ' ') AS passage FROM r""",
    "body_join": """WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS a, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS b, regexp_extract(html, '<b>([^<]*)<', 1) AS c FROM pages)
SELECT page_id, concat_ws(chr(10), CASE WHEN a <> '' AND NOT contains(b, a) AND NOT contains(c, a) THEN a END, CASE WHEN b <> '' AND NOT contains(c, b) THEN b END, CASE WHEN c <> '' THEN c END) AS body FROM p""",
    "claim_ids": f"WITH {_SENT} SELECT DISTINCT doc_id, 'clm_' || left(sha1('pkt_' || left(sha1('text|' || doc_id || '|0'), 12) || '|' || {fill(_NORM, 'sentence')}), 12) AS claim_id, {fill(_NORM, 'sentence')} AS normalized FROM sent",
    "packet_ids": """SELECT doc_id AS key, 'documents' AS origin, 'pkt_' || left(sha1('text|' || left(coalesce(text, ''), 500) || '|0'), 12) AS packet_id FROM documents
UNION ALL SELECT conv_id, 'conversations', 'pkt_' || left(sha1('text|' || left(coalesce(text, ''), 500) || '|0'), 12) FROM conversations WHERE role = 'user'""",
    "top_terms": f"SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY term HAVING count(*) >= 5",
    "feature_flags": f"WITH {_FLAGGED} SELECT lang, count(*) AS n, {', '.join(f'count_if(f_{n})::BIGINT AS n_{n}' for n in [*FEATURES, *PLAIN])} FROM flag GROUP BY lang",
    "checkworthy_score": f"WITH {_SCORED} SELECT doc_id, sentence, points::INT AS points, check_worthy, claim_type, drop_reason FROM scored",
    "claim_topk": f"WITH {_TOP1} SELECT doc_id, sentence, confidence, claim_type, check_worthy FROM top1",
    "priority_topk": f"""WITH {_SCORED}, d AS (SELECT DISTINCT doc_id, sentence, 0.6::DOUBLE * confidence + 0.4::DOUBLE * CASE claim_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in V.RISK.items())} ELSE 0.5 END AS p FROM scored WHERE check_worthy),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, sentence) AS rank FROM d) SELECT doc_id, sentence, rank::INT AS rank, round(p, 6) AS priority FROM r WHERE rank <= 8""",
    "canonical_url": f"WITH {_PAGES} SELECT page_id, url, domain FROM canon",
    "source_tier": f"""WITH {_PAGES}, m AS (SELECT c.page_id, c.domain, l.tier, row_number() OVER (PARTITION BY c.page_id ORDER BY length(entry) DESC NULLS LAST, entry DESC) AS k FROM canon c LEFT JOIN {_LISTED} ON c.domain = split_part(entry, '/', 1) OR c.domain LIKE '%.' || split_part(entry, '/', 1)),
t AS (SELECT page_id, domain, coalesce(tier, 'other') AS tier FROM m WHERE k = 1) SELECT *, CASE tier {' '.join(f"WHEN '{k}' THEN {v}" for k, v in V.TIERS.items())} END::DOUBLE AS source_weight FROM t""",
    "page_dedupe": rf"""WITH src AS (SELECT page_id, regexp_replace(lower(url), '\?page=.*$|\.html$', '') AS url FROM pages), {fill(_CANON, "src")},
p AS (SELECT canon.domain AS claim_id, canon.url AS key, src.url AS url, regexp_extract(html, '<b>([^<]*)<', 1) AS snippet, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % 7 = 0 AS decisive, page_id AS seq FROM canon JOIN src USING (page_id) JOIN pages USING (page_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, key ORDER BY length(snippet) DESC, seq) AS k, bool_or(decisive) OVER g AS any_d, count(*) OVER g AS copies, first_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY claim_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ft,
  first_value(nullif(snippet, '') IGNORE NULLS) OVER (PARTITION BY claim_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fs FROM p WINDOW g AS (PARTITION BY claim_id, key))
SELECT claim_id, url, coalesce(nullif(snippet, ''), fs) AS snippet, coalesce(nullif(title, ''), ft) AS title, any_d AS decisive, seq, copies FROM r WHERE k = 1""",
    "page_text": rf"""WITH {_PAGES}, v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_UNESC}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages) SELECT url, length(t)::INT AS n, sha1(t) AS digest FROM canon JOIN v USING (page_id)""",
    "message_route": f"""WITH r AS (SELECT page_id AS key, 'see ' || url AS text FROM pages UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations), u AS (SELECT key, {_ROUTE} AS route, {_URLS} AS f FROM r)
SELECT key, route, CASE WHEN f LIKE 'www.%' THEN 'https://' || f ELSE f END AS first_url FROM u""",
    "query_build": f"""WITH {_TOP1}, c AS (SELECT doc_id::VARCHAR AS claim_id, {fill(_ADDR, "sentence")} AS t, claim_type, doc_id % 3 = 0 AS hi, regexp_extract_all(sentence, '[A-Z][a-z]+')[1:8] AS t8 FROM top1),
k AS (SELECT *, {_QUERY_TERMS} AS terms, {_truncated("t", V.ROUTED_CHARS)} AS short FROM c WHERE t <> ''),
u AS (SELECT claim_id, claim_type, 0 AS pos, t AS x, 'verbatim' AS kind, CASE WHEN hi THEN 'hi' ELSE 'en' END AS language, '' AS sites FROM k
  UNION ALL SELECT claim_id, claim_type, 1, array_to_string(terms[1:6], ' '), 'keywords', CASE WHEN hi THEN 'hi' ELSE 'en' END, '' FROM k WHERE len(t8) > 0
  UNION ALL SELECT claim_id, claim_type, 2, short || ' ' || {_WORDS_OF}, 'routed', CASE WHEN hi THEN 'hi' ELSE 'en' END, {_SITES_OF} FROM k
  UNION ALL SELECT claim_id, claim_type, 3, short || ' ' || {_HINDI_OF}, 'routed', 'hi', {_SITES_OF} FROM k WHERE hi),
v AS (SELECT * REPLACE ({_truncated(fill(_ADDR, "x"), V.QUERY_CHARS)} AS x) FROM u),
f AS (SELECT * FROM v WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY claim_id, lower(x), language ORDER BY pos) = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS up, row_number() OVER (PARTITION BY claim_id ORDER BY pos DESC) AS down FROM f)
SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY pos)::INT AS rank, x AS text, kind, language, sites FROM e WHERE up = 1 OR down <= 2""",
    "claim_overlap_topk": f"WITH {_PAIRS} SELECT claim_id, item_id, shared, terms::INT AS terms, row_number() OVER (PARTITION BY claim_id ORDER BY shared::DOUBLE / terms DESC, item_id)::INT AS rank FROM hit QUALIFY rank <= 10",
    "aboutness": f"WITH {_ABOUT} SELECT claim_id, item_id, answer, CASE WHEN unclear THEN 0 ELSE len(s) END::INT AS shared, CASE WHEN unclear THEN 0 ELSE len(a) - len(s) END::INT AS claim_only, CASE WHEN unclear THEN 0 ELSE len(b) - len(s) END::INT AS evidence_only FROM about",
    "decisive_flag": f"WITH {_ABOUT} SELECT claim_id, item_id, item_id % 3 <> 0 AND item_id % 2 = 0 AND item_id % 5 <> 0 AND answer <> 'not_about' AS decisive FROM about",
    "candidate_rank_cap": f"""WITH {_PAIRS} SELECT claim_id, printf('ev_%012d', item_id) AS id, row_number() OVER (PARTITION BY claim_id ORDER BY item_id % 4 = 0 DESC, CASE WHEN item_id % 5 = 0 THEN 0.5 ELSE 1.0 END DESC, shared DESC, coalesce(text, '') = '', item_id)::INT AS rank FROM pair QUALIFY rank <= 10""",
    "ratings": f"SELECT raw, {_rated(V.RATING_GROUPS, q('unknown'))} AS rating, {_rated(V.RATING_STANCES, 'NULL')} AS stance FROM (VALUES {', '.join(f'({q(x)})' for x in RATINGS)}) AS r(raw)",
    "cosine_topk": f"WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id)::INT AS rank, round(s, 6) AS similarity FROM p WHERE s >= 0.2 QUALIFY rank <= 3",
    "image_index_match": f"WITH p AS (SELECT a.vec_id AS image_id, b.vec_id AS entry_id, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT image_id, entry_id, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, entry_id)::INT AS rank FROM p WHERE s >= 0.35 QUALIFY rank <= 3",
    "best_spelling_max": f"""WITH p AS (SELECT a.vec_id % 200 AS claim_id, b.vec_id::VARCHAR AS item_id, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 WHERE {_COS} >= 0.25), m AS (SELECT claim_id, item_id, max(s) AS score FROM p GROUP BY ALL)
SELECT claim_id, item_id, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, item_id) <= 3""",
    "shares_entity": f"""WITH m AS (SELECT l_orderkey AS packet_id, {_LI} AS claim_id, l_linenumber AS pos, l_suppkey % 5 AS e FROM lineitem), s AS (SELECT DISTINCT a.packet_id, a.claim_id AS src, b.claim_id AS dst, a.e FROM m a JOIN m b ON a.packet_id = b.packet_id AND a.e = b.e AND a.pos < b.pos)
SELECT packet_id, count(*) AS links, min(src) AS first, max(dst) AS last FROM s GROUP BY packet_id""",
    "node_upsert": "SELECT 'u' || user_id AS id, 'claim' AS kind, event_type AS name, arg_max(value::DECIMAL(12,2)::VARCHAR, event_id) AS value FROM events GROUP BY user_id, event_type",
    "graph_round_trip": "SELECT 'claim' AS kind, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT upper(event_type), count(DISTINCT user_id) FROM events GROUP BY event_type",
    "stance_replace": f"WITH {_STANCE} SELECT claim_id, evidence_id, seq, stance FROM st QUALIFY row_number() OVER (PARTITION BY claim_id, evidence_id ORDER BY seq DESC) = 1",
    "stance_totals": f"WITH {_STANCE}, t AS ({_totals('st')}) SELECT *, round(supports - refutes, 4) AS margin FROM t",
    "passage_vote": f"""WITH {_STANCE}, s AS (SELECT * FROM st WHERE stance IS NOT NULL), b AS (SELECT claim_id, evidence_id, arg_max({{'a': stance, 'b': score, 'c': seq}}, {{'x': score, 'y': -seq}}) FILTER (stance <> 'neutral' AND score >= 0.5) AS h, arg_max({{'a': 'neutral', 'b': score, 'c': seq}}, {{'x': score, 'y': -seq}}) FILTER (stance = 'neutral') AS u FROM s GROUP BY ALL)
SELECT claim_id, evidence_id, coalesce(h.a, u.a, 'neutral') AS stance, coalesce(h.b, u.b, 0.0)::DOUBLE AS score, coalesce(h.c, u.c, -1) AS pos FROM b""",
    "evidence_order": f"WITH {_STANCE} SELECT claim_id, id, row_number() OVER (PARTITION BY claim_id ORDER BY decisive DESC, score * weight DESC, weight DESC, id)::INT AS rank FROM st",
    "duplicate_links": """WITH l AS (SELECT l_orderkey AS id, min(l_shipdate)::DATE AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, least(o_orderdate::DATE, s) AS first_seen, coalesce(n, 0) AS n_duplicates FROM orders LEFT JOIN l ON id = o_orderkey""",
    "oldest_matches": """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS day FROM orders)
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day ASC NULLS LAST, o_orderkey)::INT AS rank FROM o""",
    "message_limit": "SELECT doc_id, length(substr(text, 1, 280))::INT AS n_kept, sha256(substr(text, 1, 280)) AS kept_sha256 FROM documents",
    "image_urls": "SELECT page_id, CASE WHEN page_id % 5 < 3 OR page_id % 5 = 3 AND regexp_matches(url, '^https?://') THEN nullif(url, '') END AS image_url FROM pages",
    "stance_aliases": "SELECT event_type, count(*) AS n, CASE WHEN event_type IN ('view', 'purchase') THEN 'supports' WHEN event_type IN ('click', 'error') THEN 'refutes' ELSE 'neutral' END AS stance FROM events GROUP BY 1",
    "open_claims": f"WITH {_STANCE}, {_CLAIMS} SELECT claim_id, packet_id FROM cl WHERE check_worthy AND claim_id NOT IN (SELECT claim_id FROM st WHERE weight > 0.6 AND stance IN ('supports', 'refutes'))",
    "escalation": f"""WITH {_STANCE}, {_CLAIMS} SELECT claim_id, packet_id, row_number() OVER (PARTITION BY packet_id ORDER BY confidence DESC, claim_id)::INT AS rank FROM cl
WHERE check_worthy AND claim_id % 6 <> 0 AND claim_id NOT IN (SELECT claim_id FROM st WHERE weight > 0.6 AND stance IN ('supports', 'refutes')) QUALIFY rank <= 4""",
    "claim_verdict": f"WITH {_VERDICT} SELECT * FROM fin",
    "packet_verdict": f"""WITH {_VERDICT}, w AS (SELECT packet_id, arg_min({{'l': label, 'c': confidence, 'i': claim_id}}, {{'a': {_SEV}, 'b': -confidence, 'c': claim_id}}) AS w, {', '.join(f"count_if(label = '{x}')::BIGINT AS n_{x}" for x in V.SEVERITY)}, count(*) AS n_claims FROM fin GROUP BY packet_id)
SELECT packet_id, w.l AS label, w.c AS confidence, w.i AS worst_claim, {', '.join(f'n_{x}' for x in V.SEVERITY)}, n_claims, n_claims || ' claims: ' || concat_ws(', ', {', '.join(f"CASE WHEN n_{x} > 0 THEN n_{x} || ' {x}' END" for x in V.SEVERITY)}) AS summary FROM w""",
    "recycled_images": f"""WITH i AS (SELECT l_orderkey AS p, {_LI} AS id FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 25), own AS (SELECT {_LI} AS id FROM lineitem WHERE l_linenumber <= 2 AND l_partkey % 2 = 0)
SELECT DISTINCT {_LI} AS claim_id FROM lineitem WHERE CASE WHEN {_LI} IN (SELECT id FROM own) THEN {_LI} IN (SELECT id FROM i) ELSE l_orderkey IN (SELECT p FROM i) END""",
    "date_mismatch": """WITH s AS (SELECT l_orderkey AS image_id, min(l_shipdate)::DATE AS first_seen FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey AS image_id, o_orderdate::DATE AS claimed, first_seen FROM orders JOIN s ON o_orderkey = image_id)
SELECT image_id, claimed, first_seen, date_diff('day', first_seen, claimed)::INT AS gap_days, date_diff('day', first_seen, claimed) >= 30 AS date_mismatch FROM j""",
    "timeline": """WITH u AS (SELECT o_orderkey AS p, o_orderdate::DATE AS d, 'claimed' AS type, 'claim' AS node FROM orders UNION SELECT l_orderkey, l_shipdate::DATE, 'published', l_linenumber::VARCHAR FROM lineitem
  UNION SELECT l_orderkey, min(l_shipdate)::DATE, 'first_seen', 'image' FROM lineitem GROUP BY 1 UNION SELECT o_orderkey, o_orderdate::DATE, 'message', 'packet' FROM orders)
SELECT p AS packet_id, strftime(d, '%Y-%m-%d') AS day, type, node, strftime(d, '%Y-%m-%d') AS label FROM u""",
    "confusion": f"WITH RECURSIVE {_ENGINE} SELECT expected_verdict, verdict, count(*) AS n FROM er WHERE ran GROUP BY ALL",
    "evaluation_records": f"WITH RECURSIVE {_ENGINE_MODES} SELECT doc_id::VARCHAR AS id, mode, expected_verdict, verdict, confidence, check_worthy, n_claims, array_to_string(got, ',') AS retrieved, errors FROM mr",
    "evaluation_modes": f"WITH RECURSIVE {_ENGINE_MODES} SELECT mode, {_MEASURES}, count(verdict) AS n_verdicts FROM mr GROUP BY mode",
    "evaluation_summary": f"""WITH RECURSIVE {_ENGINE}, rec AS (SELECT * FROM er), u AS (SELECT 'overall' AS block, NULL::VARCHAR AS value, * FROM rec UNION ALL SELECT 'in_corpus', in_corpus::VARCHAR, * FROM rec UNION ALL SELECT 'language', language, * FROM rec UNION ALL SELECT 'category', category, * FROM rec),
m AS (SELECT block, value, {_MEASURES} FROM u GROUP BY block, value) SELECT *, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM m""",
    "evaluation_gate": f"""WITH RECURSIVE {_ENGINE}, g AS (SELECT count_if(verdict = expected_verdict)::DOUBLE / count(*) AS a, count_if(expected_verdict NOT IN {_ACC} AND verdict IN {_ACC}) AS f FROM er)
SELECT a >= 0.9 AND f = 0 AS passed, concat_ws(';', CASE WHEN a < 0.9 THEN 'accuracy is below 0.9' END, CASE WHEN f > 0 THEN 'false_accusations is above 0' END) AS reasons FROM g""",
    "compare_runs": f"""WITH {_RECORDS}, b AS (SELECT verdict = expected_verdict AS was, CASE WHEN doc_id % 2 = 0 THEN expected_verdict ELSE verdict END AS after, * FROM rec)
SELECT CASE WHEN NOT was AND after = expected_verdict THEN 'better' WHEN was AND after <> expected_verdict THEN 'worse' WHEN verdict <> after THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM b GROUP BY 1""",
    "chat_reply": f"WITH r AS (SELECT conv_id, turn, {_reply()} AS f FROM conversations) SELECT conv_id, turn, CASE WHEN length(f) > 900 THEN {_truncated('f', 900)} || ' ...' ELSE f END AS reply FROM r",
    "request_check": "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' AND strlen(coalesce(text, '')) = 0 THEN 'empty' WHEN length(text) > 5000 THEN 'too long' WHEN strlen(text) > 30000 THEN 'too large' END AS refused FROM documents",
    "event_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sliding": "WITH u AS (SELECT date_trunc('hour', ts) AS s FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) SELECT s AS start, count(*) AS n FROM u GROUP BY 1",
    "event_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, s""",
    "stream_merge": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "claim_dedupe": f"""WITH RECURSIVE {_sentences_of("conversations", "conv_id, turn", "cs")}, cf AS (SELECT *, {_FLAGS}, {fill(_TOKENS, 'sentence')} AS tokens FROM cs),
sc AS (SELECT conv_id, turn, n, sentence, p / 1000.0::DOUBLE AS confidence, p >= {V.WORTHY} AS check_worthy FROM (SELECT *, {_points()} AS p FROM cf)), {_survivors("sc", "conv_id", "turn, n")}
SELECT conv_id, turn, n::INT AS n, sentence, confidence FROM kept""",
    "source_fanout": f"""WITH q AS (SELECT conv_id || '-' || turn AS claim_id, text, {_overlap_words("text")} AS w FROM conversations WHERE role = 'user' AND trim(text) <> ''),
b AS (SELECT *, ('0x' || left(md5(claim_id), 8))::BIGINT % (SELECT ceil(count(*) / 16.0)::BIGINT FROM q) AS batch FROM q), bad AS (SELECT batch FROM b GROUP BY batch HAVING max(length(text)) > 400),
s AS (SELECT claim_id, item_id FROM b, (SELECT item_id, {_overlap_words("text")} AS i FROM benchmark) WHERE len(w) > 0 AND len(list_intersect(w, i))::DOUBLE / len(w) >= 0.3 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY len(list_intersect(w, i))::DOUBLE / len(w) DESC, item_id) <= 3)
SELECT 'web' AS source, claim_id, 1::BIGINT AS candidates, 0 AS tries FROM b UNION ALL SELECT 'factcheck', claim_id, CASE WHEN batch IN (FROM bad) THEN 0 ELSE 1 END, CASE WHEN batch IN (FROM bad) THEN 2 ELSE 0 END FROM b
UNION ALL SELECT 'seed_index', claim_id, count(*), 0 FROM s GROUP BY claim_id""",
    "passage_stances": f"""WITH {_ABOUT}, pp AS (SELECT claim_id, item_id, claim, flatten(list_transform({_pieces(fill(_CLEAN, "text"))}, lambda x: {_LONG})) AS l FROM about),
pg AS (SELECT *, len(l) AS n, ceil(len(l) / 3.0)::INT AS k, CASE WHEN len(l) > 3 AND len(l) % 3 = 1 THEN 1 ELSE 0 END AS lack FROM pp WHERE len(l) > 0),
pr AS (SELECT *, unnest(range(0, k)) AS i FROM pg),
px AS (SELECT claim_id, item_id, claim, i AS pos, array_to_string(l[(i * 3 - CASE WHEN i = k - 1 THEN lack ELSE 0 END + 1):(CASE WHEN i = k - 2 THEN (i + 1) * 3 - lack WHEN i = k - 1 THEN n ELSE (i + 1) * 3 END)], ' ') AS passage FROM pr),
pt AS (SELECT *, {_terms("claim")} AS a, {_terms("passage")} AS b FROM px),
pm AS (SELECT *, coalesce(round(len(list_intersect(a, b)) / nullif(sqrt((len(a) * len(b))::DOUBLE), 0), 4), 0.0) AS sim FROM pt),
rk AS (SELECT *, row_number() OVER (PARTITION BY claim_id, item_id ORDER BY sim DESC, pos) AS rank, max(sim) OVER (PARTITION BY claim_id, item_id) AS best FROM pm),
wd AS (SELECT *, list_distinct(regexp_extract_all(lower(passage), '[a-z]+')) AS p, list_distinct(regexp_extract_all(lower(claim), '[a-z]+')) AS h FROM rk WHERE sim >= 0.3 AND rank <= 3),
wc AS (SELECT *, len(list_intersect(p, h)) AS both_, len(p) - len(list_intersect(p, h)) AS rest, len(h) - len(list_intersect(p, h)) AS lack, greatest(1, len(list_distinct(list_concat(p, h)))) AS u FROM wd),
wv AS (SELECT *, round(both_::DOUBLE / u, 4) AS s, round(rest::DOUBLE / u, 4) AS nn, round(lack::DOUBLE / u, 4) AS r, CASE WHEN both_ >= rest AND both_ >= lack THEN 'supports' WHEN rest >= lack THEN 'neutral' ELSE 'refutes' END AS v FROM wc),
wn AS (SELECT claim_id, item_id, arg_max({{'v': v, 's': greatest(s, r), 'sim': sim, 'p': passage}}, {{'a': greatest(s, r), 'b': sim, 'c': -pos}}) FILTER (v <> 'neutral' AND greatest(s, r) >= 0.5) AS side,
  arg_max({{'v': 'neutral', 's': nn, 'sim': sim, 'p': passage}}, {{'a': nn, 'b': sim, 'c': -pos}}) AS calm FROM wv GROUP BY ALL),
bb AS (SELECT claim_id, item_id, max(best) AS best FROM rk GROUP BY ALL)
SELECT claim_id, item_id AS id, coalesce(side.v, calm.v, 'neutral') AS stance, coalesce(side.s, calm.s, 0.0) AS stance_score, CASE WHEN best IS NULL THEN 'unavailable' WHEN calm IS NULL THEN 'off_topic' ELSE 'nli' END AS method,
  coalesce(side.sim, calm.sim, best, 0.0) AS relevance, sha1(coalesce(side.p, calm.p, '')) AS best FROM about LEFT JOIN bb USING (claim_id, item_id) LEFT JOIN wn USING (claim_id, item_id)""",
    "model_claim_rows": """WITH e AS (SELECT event_id, event_type AS t, value::VARCHAR AS v, json_extract_string(props, '$.k') AS k FROM events),
c AS (SELECT event_id, 0 AS n, t || ' of ' || v AS text, 'event' AS claim_type, least(1.0, (k || 'e-1')::DOUBLE) AS confidence, NULL AS attributed_to, '' AS entities FROM e WHERE t = 'view'
  UNION ALL SELECT event_id, 1, t || ' of ' || v, 'generic', 1.0, NULL, '' FROM e WHERE t = 'view'
  UNION ALL SELECT event_id, 0, t || ' of ' || v, 'generic', ('0.' || k)::DOUBLE, NULL, 'NUMBER:' || v FROM e WHERE t = 'click'
  UNION ALL SELECT event_id, 0, t || ' of ' || v, 'money', 0.5, 'shop', 'NUMBER:' || v FROM e WHERE t = 'purchase')
SELECT event_id, n, text, claim_type, confidence, attributed_to, NULL::VARCHAR AS said, entities FROM c""",
}

SQL["stored_index_match"] = SQL["image_index_match"]
# the first round without true items; of each message the four surest claims without a side go on to the true ones
SQL["second_round"] = f"""WITH RECURSIVE {_ENGINE.split("hits AS (")[0]}
hits AS (SELECT claim_id, packet_id, confidence, sentence, terms, item_id, it_terms, item_text, rating, len(list_intersect(w, iw))::DOUBLE / len(w) AS o FROM cw, it WHERE len(w) > 0 AND len(list_intersect(w, iw))::DOUBLE / len(w) >= 0.3),
ev AS (SELECT *, 'ev_' || left(sha1(claim_id || '|seed_index|https://check.example.org/' || item_id), 12) AS id, CASE WHEN {fill(_SCRIPT, 'sentence')} <> {fill(_SCRIPT, 'item_text')} OR least(len(terms), len(it_terms)) < {V.ABOUT_LEAST_TERMS} THEN 'unclear'
  WHEN len(list_intersect(terms, it_terms))::DOUBLE / least(len(terms), len(it_terms)) >= {V.ABOUT_FLOOR} THEN 'about' ELSE 'not_about' END AS about FROM hits QUALIFY row_number() OVER (PARTITION BY claim_id, rating = 'true' ORDER BY o DESC, item_id) <= 3),
sided AS (SELECT DISTINCT claim_id FROM ev WHERE rating <> 'true' AND about <> 'not_about'),
op AS (SELECT packet_id, claim_id FROM cm WHERE claim_id NOT IN (FROM sided) QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY confidence DESC, claim_id) <= 4),
ne AS (SELECT ev.* FROM ev JOIN op USING (packet_id, claim_id) WHERE rating = 'true'),
st AS (SELECT claim_id, true AS second, rating <> 'true' AS against, about, rating, o, id FROM ev WHERE rating <> 'true' UNION ALL SELECT claim_id, true, false, about, rating, o, id FROM ne),
tv AS (SELECT claim_id, sum(CASE WHEN against AND about <> 'not_about' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN NOT against AND about <> 'not_about' THEN 1 ELSE 0 END) AS s, arg_max(rating, id) FILTER (WHERE against AND about <> 'not_about' AND o >= {V.DECISIVE_OVERLAP}) AS hit FROM st GROUP BY claim_id),
lc AS (SELECT packet_id, claim_id, CASE WHEN hit IS NOT NULL THEN hit WHEN coalesce(r, 0) >= 1 THEN 'false' ELSE 'unverified' END AS l1,
  CASE WHEN hit IS NOT NULL THEN hit WHEN coalesce(r, 0) >= 1 AND r >= 2 * s THEN 'false' WHEN coalesce(s, 0) >= 1 AND s >= 2 * r THEN 'true' WHEN coalesce(s, 0) > 0 AND r > 0 THEN 'disputed' ELSE 'unverified' END AS l2 FROM cm LEFT JOIN tv USING (claim_id)),
lp AS (SELECT packet_id, arg_min(l1, {_SEV.replace("label", "l1")}) AS before, arg_min(l2, {_SEV.replace("label", "l2")}) AS after FROM lc GROUP BY packet_id)
SELECT packet_id, before, after, (SELECT count(*) FROM op WHERE op.packet_id = lp.packet_id) AS claims, (SELECT count(*) FROM ne WHERE ne.packet_id = lp.packet_id) AS found FROM lp WHERE packet_id IN (SELECT packet_id FROM op)"""
