"""DuckDB SQL for the rows of the library's own queries.

DuckDB's regular expressions have no lookaround, so guards that a pattern only looks at are consumed here; for
whether there is a match that is the same. The decoded variants of a text aren't modelled: no text of the tables
hides anything in them.
"""

from __future__ import annotations

import hashlib

from ..functions import intent
from ..operators.decide import _OWNED, _QUESTION, COMPACT_PHRASES
from ..policies import BUILT_IN, CRITICAL, LABELS, REASONS, TOPIC_CODES
from .examples import ADAPTED_CUES, POLICY_CUES, VARIANT_CUES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _norm(column: str) -> str:
    return f"replace(lower(trim(regexp_replace({column}, '[ \\t\\n\\r]+', ' ', 'g'))), 'ß', 'ss')"


def _folded(pattern: str) -> str:
    for look, guard in ((r"(?<!\d)", r"(?:^|\D)"), (r"(?<!\w)", r"(?:^|\W)"), (r"(?!\d)", r"(?:\D|$)"), (r"(?!token\b)", "")):
        pattern = pattern.replace(look, guard)
    return "(?i)" + pattern


def _has(pattern: str, column: str = "v") -> str:
    return f"regexp_matches({column}, {_q(_folded(pattern))})"


_LUHN = (
    "(len({0}) BETWEEN 13 AND 19 AND len(replace({0}, {0}[1], '')) > 0 AND list_sum(list_transform(range(1, len({0}) + 1), "
    "lambda i: CASE WHEN (len({0}) - i) % 2 = 1 THEN CASE WHEN {0}[i]::INT * 2 > 9 THEN {0}[i]::INT * 2 - 9 ELSE {0}[i]::INT * 2 END ELSE {0}[i]::INT END)) % 10 = 0)"
)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPECIAL = {
    "CREDIT_CARD": "len(list_filter(list_transform(regexp_extract_all(' ' || v, '[^0-9]((?:[0-9][ -]?){13,19})(?:[^0-9]|$)', 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: " + _LUHN.format("d") + ")) > 0",
    "IP_ADDRESS": f"regexp_matches(v, '(?:^|[^0-9a-f:.])\\.*{_OCTET}(?:\\.{_OCTET}){{3}}\\.*(?:[^0-9a-f:.]|$)') OR regexp_matches(v, '(?:^|[^0-9a-f:.])(?:[0-9a-f]{{1,4}})?::(?:[0-9a-f]{{1,4}})?(?:[^0-9a-f:.]|$)')",
    "INTERNAL_KEYWORD": "contains(v, 'test-orion')",
    "INTERNAL_DOMAIN": "contains(v, 'corp.example') OR contains(v, 'internal.example') OR regexp_matches(v, 'https?://(?:[^\\s<>/?#]*@)?[^\\s<>/?#:@]*\\.(?:local|internal|corp)(?:[:/?#\\s<>]|$)')",
    "CONNECTION_STRING": "regexp_matches(v, 'https?://[^\\s<>/?#]*@')",
    "ENTROPY": "len(list_filter(regexp_extract_all(v, '[a-zA-Z0-9_+/=-]{24,}'), lambda t: regexp_matches(t, '[0-9]') AND list_entropy(string_split(t, '')) >= 4.1)) > 0",
}


def _condition(code: str, category: str, pattern: str) -> str:
    parts = []
    if pattern:
        parts.append(f"({_has(pattern)} AND NOT q)" if code in TOPIC_CODES else _has(pattern))
    if code in _SPECIAL:
        parts.append(f"({_SPECIAL[code]})")
    gate = f"{_has(intent.REFERENCE)} AND {_has(intent.ACTION)}"
    if code == "POLICY_OVERRIDE":
        parts += [_has(p) for p in intent.OVERRIDES]
    if code in intent.IDENTITY_CODES:
        parts.append(f"({gate} AND {_has(intent.IDENTITY)} AND {_has(intent.IDENTITY_CODES[code])})")
    if code in intent.PAIRS:
        parts.append(f"({gate} AND {' AND '.join(_has(p) for p in intent.PAIRS[code])})")
    parts += [f"contains(c, {_q(p)})" for p in COMPACT_PHRASES.get(code, [])]
    return " OR ".join(parts) or "false"


def _topic(column: str) -> str:
    return f"(regexp_full_match({column}, {_q(_QUESTION + r'\s+(?:(?:an?|the)\s+)?[a-z][a-z -]{2,100}[?.]?')}) AND NOT {_has(_OWNED, column)})"


def judged(source: str, key: str, text: str) -> str:
    """CTEs texts(key..., v, q, c) and hits(key, code, category, severity)."""
    rules = ", ".join(f"({_q(c)}, {_q(k)}, {_q('critical' if k in CRITICAL else 'high')})" for c, k, _ in BUILT_IN)
    cases = " UNION ALL ".join(f"SELECT {key}, {_q(c)} AS code FROM texts WHERE {_condition(c, k, p)}" for c, k, p in BUILT_IN)
    reasons = ", ".join(f"({_q(k)}, {_q(r)})" for k, r in REASONS.items())
    return (
        f"texts0 AS (SELECT *, {_norm(text)} AS v FROM {source}), texts AS MATERIALIZED (SELECT *, {_topic('v')} AS q, regexp_replace(translate(v, '013457', 'oieast'), '[^a-z0-9]', '', 'g') AS c FROM texts0), "
        f"rules(code, category, severity) AS (VALUES {rules}), reasons(category, reason) AS (VALUES {reasons}), "
        f"hits AS MATERIALIZED (SELECT * FROM ({cases}) JOIN rules USING (code) JOIN reasons USING (category)), "
        f"result AS (SELECT t.*, h.code IS NOT NULL AS blocked, h.severity, h.codes, h.reasons FROM texts t LEFT JOIN (SELECT {key}, min(code) AS code, "
        f"CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'high' END AS severity, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM hits GROUP BY {key}) h USING ({key}))"
    )


_DOCS = judged("documents", "doc_id", "text")
_DECISION = "CASE WHEN blocked THEN 'BLOCKED' ELSE 'ALLOWED' END"
_TRUTH = f"WITH {_DOCS}, truth AS (SELECT r.*, l.toxic FROM result r JOIN labels l USING (doc_id))"
_LABEL = "CASE toxic WHEN 0 THEN 'allowed' WHEN 1 THEN 'blocked_prompt_injection' END"


def _bucket(digest: str, of: int) -> str:
    return f"(concat('0x', {digest}[1:8])::BIGINT % {of})"


def _has_any(column: str, *names: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in names) + ")"


def _split(source: str, split: str, digest: str) -> str:
    s = f"lower({split})"
    bench = f"CASE WHEN {_has_any(s, 'valid', 'dev')} THEN 'validation' WHEN contains({s}, 'train') AND {_bucket(digest, 10)} = 0 THEN 'train' ELSE 'test' END"
    return (
        f"CASE WHEN {source} = 'pii-bench' THEN {bench} WHEN {source} IN ('pii-bench', 'pii-trace', 'bipia', 'stef41') OR {_has_any(s, 'test', 'benchmark', 'eval')} THEN 'test' "
        f"WHEN {_has_any(s, 'valid', 'dev')} THEN 'validation' WHEN {_bucket(digest, 100)} < 80 THEN 'train' WHEN {_bucket(digest, 100)} < 90 THEN 'validation' ELSE 'test' END"
    )


_RAW = (
    "raw AS (SELECT doc_id, text, source, toxic, ['unspecified', 'train', 'validation', 'test', 'unspecified', 'unspecified', 'unspecified'][(doc_id % 7 + 1)::INT] AS split, "
    f"'g' || (doc_id // 5)::VARCHAR AS group_id, {_LABEL} AS label, sha256({_norm('text')}) AS digest FROM documents JOIN labels USING (doc_id))"
)
_RANKED = f"{_RAW}, ranked AS (SELECT *, CASE {_split('source', 'split', 'sha256(group_id)')} WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS rank FROM raw)"
_SCORES = (
    f"WITH sized AS (SELECT vec_id, {LABELS!r}[label % 7 + 1] AS label, list_transform(embedding[1:7], lambda x: abs(x::DOUBLE)) AS s FROM embeddings), "
    "scored AS (SELECT vec_id, label, list_transform(s, lambda x: x / (s[1] + s[2] + s[3] + s[4] + s[5] + s[6] + s[7])) AS s FROM sized), "
    f"won AS (SELECT *, s[1] AS allowed, list_max(s[2:7]) AS best, {LABELS[1:]!r}[list_position(s[2:7], list_max(s[2:7]))] AS winner FROM scored)"
)


def _knapsack(rate: float, floor: float) -> str:
    """The bars of class_thresholds: one step a label, each keeping the best value of a total cost."""
    steps = ["s0 AS (SELECT 0::BIGINT AS total, 0::DOUBLE AS value, []::DOUBLE[] AS bars)"]
    for i, name in enumerate(LABELS[1:], 1):
        steps.append(
            f"s{i} AS (SELECT s.total + o.cost AS total, s.value + o.gain AS value, list_append(s.bars, o.bar) AS bars FROM s{i - 1} s JOIN options o ON o.winner = '{name}' "
            "WHERE s.total + o.cost <= (SELECT b FROM budget) QUALIFY row_number() OVER (PARTITION BY s.total + o.cost ORDER BY s.value + o.gain DESC, o.cost) = 1)"
        )
    return (
        f"{_SCORES}, budget AS (SELECT floor(count(*) * {rate}::DOUBLE)::BIGINT AS b FROM won WHERE label = 'allowed'), sizes AS (SELECT label AS winner, count(*) AS n FROM won GROUP BY label), "
        f"tied AS (SELECT winner, best, sum((label = winner)::INT) AS t, sum((label = 'allowed')::INT) AS f FROM won WHERE best > allowed AND best > {floor} GROUP BY ALL), "
        "summed AS (SELECT winner, best, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM tied WINDOW w AS (PARTITION BY winner ORDER BY best DESC ROWS UNBOUNDED PRECEDING)), "
        "found AS (SELECT winner, fp::BIGINT AS cost, max(tp)::DOUBLE / greatest(coalesce(any_value(n), 0), 1) AS gain, arg_max(best, (tp, best)) AS bar FROM summed LEFT JOIN sizes USING (winner) GROUP BY winner, fp), "
        f"options AS (SELECT * FROM found WHERE cost > 0 OR gain > 0 UNION ALL SELECT x, 0, 0, 1 FROM (SELECT unnest({LABELS[1:]!r}) AS x) WHERE x NOT IN (SELECT winner FROM found WHERE cost = 0 AND gain > 0)), "
        + ", ".join(steps)
        + f", top AS (SELECT bars FROM s{len(LABELS) - 1} ORDER BY value DESC, total LIMIT 1) SELECT unnest({LABELS[1:]!r}) AS label, round(unnest(bars), 6) AS threshold FROM top"
    )


_TURNS = judged("(SELECT concat_ws('-', conv_id, turn) AS request_id, text FROM conversations WHERE octet_length(encode(text)) <= 70000 AND length(text) <= 16000 AND regexp_matches(text, '\\S'))", "request_id", "text")


def _hmac(algorithm: str, salt: str, secret: str, value: str) -> str:
    """HMAC by its definition: the key is the digest of salt and secret, padded to a block."""
    key = hashlib.new(algorithm, (salt + secret).encode()).digest().ljust(64, b"\0")
    inner, outer = (f"unhex('{bytes(b ^ mask for b in key).hex()}')" for mask in (0x36, 0x5C))
    return f"{algorithm}({outer} || unhex({algorithm}({inner} || encode({value}))))"


_ADDRESS = "CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE 'unknown' END"
_SAMPLED = f"WITH {_RAW}, sampled AS (SELECT DISTINCT label, digest FROM raw)"

SQL = {
    "normalize_digest": f"SELECT doc_id, sha256({_norm('text')}) AS digest FROM documents",
    "prompt_hashes": "SELECT doc_id, sha256(text) AS prompt_hash FROM documents",
    "sampling_digest": f"SELECT conv_id, turn, sha256({_norm('text')}) AS digest FROM conversations",
    "leet_compact": f"SELECT doc_id, sha256(regexp_replace(translate({_norm('text')}, '013457', 'oieast'), '[^a-z0-9]', '', 'g')) AS compact_sha256 FROM documents",
    "entropy_tokens": f"SELECT doc_id, token, round(list_entropy(string_split(token, '')), 6) AS entropy FROM (SELECT doc_id, unnest(regexp_extract_all({_norm('text')}, '[a-z0-9_+/=-]{{24,}}')) AS token FROM documents)",
    "luhn_candidates": f"SELECT doc_id, digits, {_LUHN.format('digits')} AS valid FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: len(d) BETWEEN 13 AND 19)) AS digits FROM documents)",
    "policy_hits": f"WITH {_DOCS} SELECT DISTINCT doc_id, code FROM hits",
    "decisions": f"WITH {_DOCS} SELECT doc_id, {_DECISION} AS decision, severity AS highest_severity, coalesce(codes, '') AS codes, coalesce(reasons, '') AS reasons FROM result",
    "decision_summary": f"WITH {_DOCS} SELECT {_DECISION} AS decision, count(*) AS n FROM result GROUP BY 1",
    "codes_by_lang": f"WITH {_DOCS} SELECT t.lang, code, count(*) AS n FROM (SELECT DISTINCT doc_id, code FROM hits) JOIN texts t USING (doc_id) GROUP BY ALL",
    "severity_rollup": f"WITH {_DOCS} SELECT lang, severity, count(*) AS n FROM (SELECT lang, coalesce(severity, 'none') AS severity FROM result) GROUP BY ROLLUP (lang, severity)",
    "reason_counts": f"WITH {_DOCS} SELECT reason, count(DISTINCT doc_id) AS n FROM hits GROUP BY reason",
    "chunk_windows": "SELECT doc_id, o AS \"offset\", length(text[o + 1:o + 8000]) AS characters, sha256(text[o + 1:o + 8000]) AS chunk_sha256 FROM (SELECT doc_id, text, unnest(range(0, length(text), 7500)) AS o FROM documents)",
    "cross_turn_text": "SELECT conv_id, length(t) AS characters, sha256(t) AS joined_sha256 FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "seed_merge": "WITH seeds(code, category, severity, enabled, pattern) AS (VALUES "
    + ", ".join(f"({_q(c)}, {_q(k)}, {_q('critical' if k in CRITICAL else 'high')}, true, {_q(p)})" for c, k, p in BUILT_IN)
    + "), mine(code, category, severity, enabled, pattern) AS (VALUES ('EMAIL', 'pii', 'low', false, 'x@y'), ('PHONE', 'pii', 'low', true, (SELECT pattern FROM seeds WHERE code = 'PHONE'))) "
    "SELECT 'PART_' || p_partkey::VARCHAR AS code, 'confidential_data' AS category, 'low' AS severity, p_size > 10 AS enabled, '' AS pattern FROM part UNION ALL SELECT * FROM mine UNION ALL SELECT * FROM seeds WHERE code NOT IN (SELECT code FROM mine)",
    "topic_questions": f"SELECT p_partkey, {_topic('q')} AS topic FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'what is our ' WHEN 1 THEN 'what is ' ELSE 'tell me about the ' END || lower(p_type) || '?' AS q FROM part)",
    "label_adapter": f"SELECT {_LABEL} AS label, quality, count(*) AS n FROM labels GROUP BY ALL",
    "raw_row_adapter": f"WITH {_RAW} SELECT doc_id, label, split, group_id, sha256(text) AS text_sha256 FROM raw",
    "split_buckets": f"SELECT source, {_split('source', _q('unspecified'), 'sha256(doc_id::VARCHAR)')} AS split, count(*) AS n FROM documents GROUP BY ALL",
    "dedupe_records": f"WITH {_RANKED} SELECT digest AS text_sha256, arg_min(label, (source, doc_id)) AS label, min(source) AS source, count(*) AS n_rows, max(rank)::BIGINT AS rank, count(DISTINCT label) > 1 AS conflict, count(*) - 1 AS duplicates FROM ranked GROUP BY digest",
    "group_propagation": f"WITH RECURSIVE {_RANKED}, reach(digest, rank) AS (SELECT digest, max(rank) FROM ranked GROUP BY digest UNION SELECT b.digest, r.rank FROM reach r JOIN ranked a USING (digest) JOIN ranked b ON a.source = b.source AND a.group_id = b.group_id) "
    "SELECT digest AS text_sha256, ['train', 'validation', 'test'][max(reach.rank) + 1] AS split, (SELECT count(DISTINCT label) > 1 FROM raw WHERE raw.digest = reach.digest) AS conflict FROM reach GROUP BY digest",
    "provenance_filter": "WITH p AS (SELECT doc_id, ['alpha', 'pii-bench', 'pii-trace', 'bipia', 'stef41'][(doc_id % 5 + 1)::INT] AS source, ['train', 'valid', 'test', 'dev', 'eval', 'unspecified'][(doc_id // 5 % 6 + 1)::INT] AS o, ['train', 'dev', 'benchmark'][(doc_id // 30 % 3 + 1)::INT] AS r, ['train', 'validation', 'test'][(doc_id // 2 % 3 + 1)::INT] AS split FROM documents) "
    f"SELECT doc_id, split, CASE WHEN split = 'test' THEN true WHEN {_has_any('o', 'test', 'benchmark', 'eval')} OR {_has_any('r', 'test', 'benchmark', 'eval')} OR source IN ('pii-trace', 'bipia', 'stef41') THEN false "
    f"WHEN source = 'pii-bench' THEN CASE WHEN split = 'train' THEN contains(o, 'train') AND contains(r, 'train') ELSE {_has_any('o', 'train', 'valid', 'dev')} END "
    f"ELSE NOT (split = 'train' AND ({_has_any('o', 'valid', 'dev')} OR {_has_any('r', 'valid', 'dev')})) END AS allowed FROM p",
    "bipia_compose": "WITH a AS (SELECT item_id AS i, text FROM benchmark), c AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS i, html, page_id FROM pages), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM c) AS nc), "
    "t AS (SELECT unnest(range(greatest(na, nc))) AS turn, na, nc FROM n) SELECT turn, 'blocked_prompt_injection' AS label, 'p.jsonl:' || page_id::VARCHAR AS group_id, 'a.json:c' AS source, 'test' AS split, "
    "sha256('Summarize this retrieved document:' || chr(10) || '<document>' || chr(10) || html || chr(10) || text || chr(10) || '</document>') AS text_sha256 FROM t JOIN a ON turn % na = a.i JOIN c ON turn % nc = c.i",
    "topk_per_label": f"{_SAMPLED} SELECT label, digest FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY digest) AS r FROM sampled) WHERE r <= CASE label WHEN 'allowed' THEN 25 ELSE 10 END",
    "balanced_sample": f"{_SAMPLED}, k AS (SELECT least(40, min(n)) AS k FROM (SELECT count(*) AS n FROM sampled GROUP BY label)) SELECT label, count(*) AS n, max(digest) AS last FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY digest) AS r FROM sampled) WHERE r <= (SELECT k FROM k) GROUP BY label",
    "leakage_check": f"WITH {_RAW} SELECT digest, count(DISTINCT split) AS splits FROM raw GROUP BY digest HAVING count(DISTINCT split) > 1",
    "single_threshold": f"{_SCORES}, tail AS (SELECT best FROM won WHERE label = 'allowed' AND best > allowed), k AS (SELECT floor(count(*) * 0.05::DOUBLE)::BIGINT AS b FROM won WHERE label = 'allowed') "
    "SELECT round(least(1.0, greatest(0.5, coalesce((SELECT best + 1e-6 FROM (SELECT best, row_number() OVER (ORDER BY best DESC) AS r FROM tail) WHERE r = (SELECT b + 1 FROM k)), 0.5)))::DOUBLE, 6) AS threshold",
    "calibrated_metrics": f"{_SCORES}, j AS (SELECT label = 'allowed' AS a, best > allowed AND best > 0.5 AS hit FROM won) SELECT round(count(*) FILTER (a AND hit) / greatest(count(*) FILTER (a), 1), 6) AS allowed_false_block_rate, "
    "round(count(*) FILTER (NOT a AND hit) / greatest(count(*) FILTER (NOT a), 1), 6) AS blocked_recall, count(*) FILTER (a) AS allowed_count, count(*) FILTER (NOT a) AS blocked_count FROM j",
    "class_candidates": f"{_SCORES}, tied AS (SELECT winner, best, sum((label = winner)::INT) AS t, sum((label = 'allowed')::INT) AS f FROM won WHERE best > allowed AND best > 0.2 GROUP BY ALL), "
    "summed AS (SELECT winner, best, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM tied WINDOW w AS (PARTITION BY winner ORDER BY best DESC ROWS UNBOUNDED PRECEDING)) "
    "SELECT winner, fp::BIGINT AS fp, max(tp)::BIGINT AS tp, round(arg_max(best, (tp, best)), 6) AS score FROM summed WHERE fp <= 3 GROUP BY winner, fp",
    "class_thresholds": _knapsack(0.05, 0.2),
    "argmax_metrics": f"{_SCORES}, g AS (SELECT label, ({LABELS!r}[list_position(s, list_max(s))] = label)::INT AS hit FROM won) SELECT label, count(*) AS rows, round(sum(hit) / count(*), 6) AS recall FROM g GROUP BY ROLLUP (label)",
    "confusion": f"{_TRUTH}, n AS (SELECT count(*) FILTER (blocked AND toxic = 1) AS caught, count(*) FILTER (NOT blocked AND toxic = 1) AS missed, count(*) FILTER (blocked AND toxic = 0) AS false_blocks, count(*) FILTER (NOT blocked AND toxic = 0) AS passed FROM truth) "
    "SELECT *, round(false_blocks / greatest(false_blocks + passed, 1), 6) AS allowed_false_block_rate, round(caught / greatest(caught + missed, 1), 6) AS blocked_recall FROM n",
    "eval_by_source": f"{_TRUTH} SELECT source, toxic, count(*) AS n, sum(blocked::INT)::BIGINT AS blocked FROM truth GROUP BY ALL",
    "gateway_evaluation": f"{_TRUTH} SELECT {_LABEL} AS label, count(*) AS total, sum(blocked::INT)::BIGINT AS deterministic, 0::BIGINT AS model_added FROM truth GROUP BY ALL",
    "false_block_codes": f"{_TRUTH} SELECT code, count(DISTINCT doc_id) AS false_blocks FROM hits JOIN labels USING (doc_id) WHERE labels.toxic = 0 GROUP BY code",
    "false_block_sources": f"{_TRUTH}, w AS (SELECT documents.source AS source, documents.lang AS lang FROM truth JOIN documents USING (doc_id) WHERE blocked AND toxic = 0) "
    "SELECT source, count(*) AS false_blocks FROM (SELECT source FROM w UNION ALL SELECT 'lang ' || lang FROM w) GROUP BY source",
    "workbook_metrics": f"WITH {_DOCS}, rows_ AS (SELECT sha256(text) AS h, {_DECISION} AS d, CASE toxic WHEN 1 THEN 'BLOCKED' WHEN 0 THEN 'ALLOWED' END AS e FROM result LEFT JOIN labels USING (doc_id)), "
    "c AS (SELECT count(*) AS n FROM (SELECT h FROM rows_ WHERE e IS NOT NULL GROUP BY h HAVING count(DISTINCT e) > 1)) SELECT count(*) AS rows, count(e) AS labeled, count(*) FILTER (d = e) AS matched, count(*) FILTER (e = 'BLOCKED' AND d = 'ALLOWED') AS false_allowed, "
    "count(*) FILTER (e = 'ALLOWED' AND d = 'BLOCKED') AS false_blocked, 0::BIGINT AS detector_errors, count(DISTINCT h) AS unique_prompts, (SELECT n FROM c) AS conflicting_label_groups, round(count(*) FILTER (d = e) / count(e), 6) AS accuracy FROM rows_",
    "rate_limit": "SELECT event_id, user_id AS identity, time_bucket(INTERVAL 1 DAY, ts) AS window_start, row_number() OVER w AS nth, row_number() OVER w > 2 AS denied FROM events WINDOW w AS (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id)",
    "rate_limit_stream": "SELECT event_id, user_id AS identity, time_bucket(INTERVAL 1 DAY, ts) AS window_start, row_number() OVER w AS nth, row_number() OVER w > 2 AS denied FROM events WINDOW w AS (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id)",
    "training_counts": f"WITH {_RAW}, once AS (SELECT digest, min(doc_id) AS doc_id, arg_min(CASE toxic WHEN 0 THEN 'allowed' ELSE {LABELS!r}[(doc_id % 7 + 1)::INT] END, doc_id) AS label FROM raw GROUP BY digest), "
    "parted AS (SELECT label, CASE WHEN doc_id % 20 < 16 THEN 'train' WHEN doc_id % 20 < 18 THEN 'validation' ELSE 'test' END AS split FROM once), counted AS (SELECT split, label, count(*) AS n FROM parted GROUP BY ALL), "
    f"whole AS (SELECT split, label, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest(['train', 'validation', 'test']) AS split), (SELECT unnest({LABELS!r}) AS label)) LEFT JOIN counted USING (split, label)) "
    "SELECT split, label, n AS source_count, least(n, CASE split WHEN 'train' THEN least(50, min(n) OVER (PARTITION BY split)) WHEN 'validation' THEN 40 ELSE 30 END) AS selected_count FROM whole",
    "masked_documents": r"SELECT doc_id, length(m)::BIGINT AS characters, sha256(m) AS masked_sha256 FROM (SELECT doc_id, "
    r"regexp_replace(regexp_replace(text, '(?i)[a-z0-9._]+@[a-z0-9.]+\.[a-z]+', '<EMAIL>', 'g'), '[0-9]+(?:\.[0-9]+){3}', '<IP_ADDRESS>', 'g') AS m FROM documents)",
    "rate_counts": "SELECT user_id AS identity, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS requests, greatest(count(*) - 2, 0) AS denied FROM events GROUP BY ALL",
    "audit_page": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
    "audit_rows": f"WITH {_TURNS} SELECT request_id, sha256(text) AS prompt_hash, {_DECISION} AS decision, coalesce(codes, '') AS codes, false AS forwarded_to_llm FROM result",
    "policy_cues": POLICY_CUES,
    "variant_cues": VARIANT_CUES,
    "own_policies": "WITH p AS (SELECT p_partkey, lower(p_name) AS v FROM part), h AS (SELECT p_partkey, contains(v, 'red') OR contains(v, 'anvil') AS word, regexp_matches(v, '^[a-m].*e$') OR regexp_matches(v, '\\bs\\w+\\s+r') AS shape FROM p) "
    "SELECT p_partkey, CASE WHEN word OR shape THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision, CASE WHEN shape THEN 'medium' WHEN word THEN 'low' END AS highest_severity, concat_ws(',', CASE WHEN shape THEN 'SHAPE' END, CASE WHEN word THEN 'WORD' END) AS codes, "
    "concat_ws('; ', CASE WHEN word THEN 'Personal data detected' END, CASE WHEN shape THEN 'Prompt injection attempt detected' END) AS reasons FROM h",
    "model_stages": "WITH h AS (SELECT p_partkey, contains(p_name, 'red') AS rule, list_contains(string_split(p_name, ' '), 'gizmo') AS attack, contains(p_name, 'blue') OR length(p_name) % 2 = 0 AS person FROM part) "
    "SELECT p_partkey, CASE WHEN rule OR attack OR person THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision, CASE WHEN rule THEN 'high' WHEN attack THEN 'critical' WHEN person THEN 'low' END AS highest_severity, "
    "CASE WHEN rule THEN 'RULE' ELSE concat_ws(',', CASE WHEN attack THEN 'ATTACK' END, CASE WHEN person THEN 'PERSON' END) END AS codes FROM h",
    "adapted_cues": ADAPTED_CUES,
    "file_sources": "WITH c AS (SELECT c_custkey AS key, '\"' || c_name || '\",' || chr(10) || c_mktsegment AS text FROM customer) "
    "SELECT source, 'unspecified' AS original_split, key, text FROM c, (VALUES ('csv'), ('jsonl'), ('parquet')) s(source) UNION ALL SELECT 'json', 'unspecified', n_nationkey, n_name FROM nation",
    "manifest_check": "WITH d AS (SELECT doc_id, 'd/' || doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing file' WHEN doc_id % 3 = 1 THEN 'checksum mismatch' END AS reason FROM documents) SELECT path, reason, reason IS NULL AS ok FROM d",
    "request_gates": "SELECT doc_id, length(text)::BIGINT AS characters FROM documents WHERE doc_id % 7 <> 0 AND regexp_matches(text, '\\S') AND length(text) <= 16000 AND octet_length(encode(text)) <= 70000",
    "identity_hashes": f"SELECT c_custkey, {_hmac('sha1', 'dlp-rate', 'k1', _ADDRESS)} AS address_hash, CASE WHEN c_custkey % 5 <> 0 THEN {_hmac('sha256', 'dlp-user', 'k1', 'c_custkey::VARCHAR')} END AS user_hash FROM customer",
}
