"""SQL for DuckDB that gives the same rows as the query of the same name."""

from __future__ import annotations

from mailprism.catalog.frames import PHRASES
from mailprism.functions import text as X
from mailprism.functions import verdict as V

DAY_MS = 86_400_000


def _round_half_even(x: str, digits: int) -> str:
    """Rounding by the exact binary value of a double column, ties to even."""
    s = f"{10**digits}::DOUBLE"
    wide = f"({x} * 134217729::DOUBLE)"
    high = f"({wide} - ({wide} - {x}))"
    y = f"({x} * {s})"
    err = f"(({high} * {s} - {y}) + ({x} - {high}) * {s})"
    half = f"({y} - floor({y}))"
    up = f"({half} > 0.5 OR ({half} = 0.5 AND ({err} > 0 OR ({err} = 0 AND floor({y})::BIGINT % 2 = 1))))"
    return f"((CASE WHEN {up} THEN floor({y}) + 1 ELSE floor({y}) END) / {s})"


def _phrase() -> str:
    cases = " ".join(f"WHEN {i} THEN ' {p}'" for i, p in enumerate(PHRASES))
    return f"CASE doc_id % 6 {cases} ELSE '' END"


_PHRASED = f"SELECT doc_id, lang, source, text || ({_phrase()}) AS text FROM documents"


def _clean(text: str) -> str:
    out = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)(https?://|www\\.)[^\\s]+', ' url ', 'g')"
    out = f"regexp_replace({out}, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.-]+', ' email ', 'g')"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g')"
    return f"lower(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


_HITS = " + ".join(f"contains(clean, '{w}')::INTEGER" for w in X.KEYWORDS)
_KEYWORDS = f"SELECT doc_id, clean, least(hits / 4.0::DOUBLE, 1.0::DOUBLE) AS score, hits FROM (SELECT *, {_HITS} AS hits FROM (SELECT doc_id, {_clean('text')} AS clean FROM ({_PHRASED})))"

_KIND = (
    "CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'html' WHEN 'purchase' THEN 'images' "
    "WHEN 'signup' THEN 'links-meta' ELSE event_type END"
)


def _results(task: str) -> str:
    return f"""SELECT {task} AS task_id, {_KIND} AS analyzer_type, least(value / 100, 1.0::DOUBLE) AS score,
        props, event_type, ts, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq FROM events"""


_DAY_TASK = "user_id || '-' || strftime(ts, '%Y-%m-%d')"
_BY_DAY = _results(_DAY_TASK)
_BY_USER = _results("user_id::VARCHAR")


def _verdict(mean: str) -> str:
    return "CASE " + " ".join(f"WHEN {mean} < {b} THEN '{v}'" for b, v in V.VERDICT_SCALE) + " END"


def _mean(scores: str) -> str:
    """Compensated sum of an ordered list of doubles over its length."""
    step = (
        "lambda a, b: {'hi': a.hi + b.hi, 'lo': a.lo + CASE WHEN abs(a.hi) >= abs(b.hi) "
        "THEN (a.hi - (a.hi + b.hi)) + b.hi ELSE (b.hi - (a.hi + b.hi)) + a.hi END}"
    )
    pairs = f"list_transform({scores}, lambda x: {{'hi': x, 'lo': 0::DOUBLE}})"
    return f"list_transform([list_reduce({pairs}, {step})], lambda s: s.hi + s.lo)[1] / len({scores})"


def _decided(results: str) -> str:
    return f"""SELECT *, {_verdict('mean')} AS verdict, {_round_half_even('mean', 3)} AS rounded FROM (
        SELECT *, {_mean('scores')} AS mean FROM (
            SELECT task_id, list(score ORDER BY ts_ms, seq) AS scores, list(analyzer_type ORDER BY ts_ms, seq) AS kinds
            FROM ({results}) GROUP BY task_id))"""


def _correlated(results: str) -> str:
    return f"""SELECT *, {_verdict('mean')} AS verdict, {_round_half_even('mean', 3)} AS score FROM (
        SELECT task_id, count(*)::INTEGER AS analyzer_count, count(DISTINCT analyzer_type)::INTEGER AS n_types,
            count(DISTINCT analyzer_type) >= 4 AS complete, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
            sum(score::VARCHAR::DECIMAL(28,18))::VARCHAR::DOUBLE / count(*) AS mean
        FROM ({results}) GROUP BY task_id)"""


_TURN = "event_id % 97"
_FIELDS = f"""'{{"task_id": "' || CASE WHEN {_TURN} = 5 THEN '' ELSE {_DAY_TASK} END || '", '
    || CASE WHEN {_TURN} = 7 THEN '' ELSE '"analyzer_type": "' || {_KIND} || '", ' END
    || '"score": ' || least(value / 100, 1.0::DOUBLE)::DECIMAL(10,4) || ', "features": ' || props || '}}'"""
_MESSAGES = f"""SELECT event_id AS seq, 'analysis.' || {_KIND} AS topic,
    CASE WHEN {_TURN} = 0 THEN '{{bad' WHEN {_TURN} = 1 THEN '[1]' WHEN {_TURN} = 2 THEN {_FIELDS} || ' trailing' ELSE {_FIELDS} END AS value
    FROM events"""
_VALID = f"SELECT * FROM ({_MESSAGES}) WHERE json_valid(value) AND json_type(value) = 'OBJECT'"

_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"
_LINKED = f"""SELECT page_id, url, replace(html, 'href="/', 'href="https://' || {_HOST} || '/') ||
    CASE WHEN page_id % 3 = 0 THEN '<a class="p-4 text-sm" href="' || url || '">www.bank.example.com</a><form style="display:none"></form>' ELSE '' END AS html
    FROM pages"""
# The supplied pages are regular: comments close, attributes are quoted, scripts end.
_MARKUP = f"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
    '(<script[^>]*>).*?(</script>)', '\\1\\2', 'gs'), '(<style[^>]*>).*?(</style>)', '\\1\\2', 'gs') AS m FROM ({_LINKED})"""
_TAGS = f"""SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n FROM (
    SELECT page_id, regexp_extract_all(m, '</?[a-zA-Z][^>]*>') AS tags FROM ({_MARKUP}))"""
_TAG_FACTS = f"""SELECT page_id, n, tag, NOT starts_with(tag, '</') AS opens, lower(regexp_extract(tag, '^<([a-zA-Z0-9]+)', 1)) AS name,
    sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY n) AS level,
    len(list_filter(string_split_regex(regexp_extract(tag, '\\sclass="([^"]*)"', 1), '\\s+'),
        lambda c: regexp_matches(c, '^(sm:|md:|lg:)?(text|bg|p|m|flex|grid|rounded|font)-'))) AS utility
    FROM ({_TAGS})"""
# Depth never falls below zero: subtract the lowest level so far where it is negative.
_DEPTH = f"SELECT *, level - least(min(level) OVER (PARTITION BY page_id ORDER BY n), 0) AS depth FROM ({_TAG_FACTS})"
_HTML_FEATURES = f"""SELECT page_id, count(*) FILTER (opens)::INTEGER AS tag_count, max(depth)::INTEGER AS max_dom_depth,
    count(*) FILTER (opens AND regexp_matches(tag, '\\sstyle='))::INTEGER AS inline_style_count,
    count(*) FILTER (opens AND name IN ('img', 'link', 'script', 'iframe'))::INTEGER AS external_resource_count,
    count(*) FILTER (opens AND (regexp_matches(tag, '\\shidden[\\s>]') OR regexp_matches(tag, 'style="[^"]*(display\\s*:\\s*none|visibility\\s*:\\s*hidden)')))::INTEGER AS hidden_element_count,
    count(*) FILTER (opens AND name = 'form')::INTEGER AS form_count, count(*) FILTER (opens AND name = 'script')::INTEGER AS script_count,
    sum(utility)::INTEGER AS tailwind_class_count FROM ({_DEPTH}) GROUP BY page_id"""
_HTML_RULES = [
    ("tailwind_class_count > 0", "0.30", "Tailwind-like utility classes in email HTML"),
    ("(script_count > 0 OR form_count > 0)", "0.25", "active or interactive HTML elements"),
    ("max_dom_depth > 12", "0.15", "unusually deep DOM"),
    ("(inline_style_count > 40 OR tag_count > 180)", "0.15", "unusually complex inline layout"),
    ("hidden_element_count > 3", "0.10", "multiple hidden elements"),
]
_POINTS = " + ".join(f"CASE WHEN {r} THEN {w} ELSE 0 END" for r, w, _ in _HTML_RULES)
_WHY = ", ".join(f"CASE WHEN {r} THEN '{t}' END" for r, _, t in _HTML_RULES)
_HTML_SCORES = f"""SELECT page_id, ({_POINTS})::DOUBLE AS score,
    coalesce(nullif(concat_ws('; ', {_WHY}), ''), 'no strong anomalous HTML structure signals') AS reason FROM ({_HTML_FEATURES})"""

_LINK_LISTS = f"""SELECT page_id, list_concat(regexp_extract_all(html, 'href="(https?://[^"\\s>]+)', 1),
    regexp_extract_all('see ' || url || ' now', 'https?://[^\\s<>")\\]]+')) AS links FROM ({_LINKED})"""
_LINKS = f"""SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS position FROM (
    SELECT page_id, link, min(n) AS first FROM (
        SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) AS n FROM ({_LINK_LISTS})) GROUP BY page_id, link)"""
_BARE_HOST = f"regexp_replace({_HOST}, '^www\\.', '')"
_LINK_SCORES = f"""SELECT page_id, (mismatch OR false) AS mismatch, bad,
    CASE WHEN mismatch THEN 0.5 ELSE 0 END + CASE WHEN bad THEN 0.4 ELSE 0 END AS points FROM (
        SELECT page_id, page_id % 3 = 0 AND {_BARE_HOST} <> 'bank.example.com' AS mismatch,
            regexp_matches({_BARE_HOST}, 'bets|casino|spam') AS bad FROM pages)"""
_LINK_REASON = """CASE WHEN mismatch AND bad THEN 'anchor text names another host than its URL; link to a suspicious domain'
    WHEN mismatch THEN 'anchor text names another host than its URL' WHEN bad THEN 'link to a suspicious domain' ELSE 'no suspicious links' END"""

_PNG = """SELECT doc_id, doc_id % 4 AS turn, doc_id % 3 = 0 AS qr, n_chars FROM documents"""

_GRAMS = """SELECT doc_id, list_concat(t, list_transform(list_zip(t[1:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) AS g
    FROM (SELECT doc_id, regexp_extract_all(clean, '[\\p{L}\\p{N}_]{2,}') AS t FROM (SELECT doc_id, %s AS clean FROM documents))"""
_DOC_TERMS = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM ({_GRAMS % _clean('text')})) GROUP BY doc_id, term"
_TERMS = f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM ({_DOC_TERMS}) GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 20000"

_LABELLED = "SELECT d.doc_id, d.text, l.toxic AS label, d.source, 1 - l.quality AS ai_assisted FROM documents d JOIN labels l USING (doc_id)"
_TURNS = """SELECT conv_id * 1000 + turn AS doc_id, text, 0 AS label,
    CASE WHEN role = 'assistant' THEN 'ai' ELSE 'human' END AS source, (role = 'assistant')::INTEGER AS ai_assisted FROM conversations"""


def _unit(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


_RATED = """SELECT vec_id, label % 2 AS label, ((list_position(embedding, list_max(embedding)) - 1) % 2)::INTEGER AS prediction FROM embeddings"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


_PER_CLASS = f"""SELECT c AS class, {_ratio('hits', 'predicted')} AS precision, {_ratio('hits', 'support')} AS recall, support FROM (
    SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted,
        count(*) FILTER (label = c AND prediction = c) AS hits FROM ({_RATED}), (SELECT DISTINCT label AS c FROM ({_RATED}) UNION SELECT DISTINCT prediction FROM ({_RATED})) GROUP BY c)"""
_PER_CLASS = f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ({_PER_CLASS})"

_CAMPAIGN_TEXT = f"SELECT doc_id, {_clean('numbered')} AS clean FROM (SELECT doc_id, text || ' order ' || (doc_id % 7) AS numbered FROM documents)"
_CAMPAIGNS = f"""SELECT sha256(pattern) AS cluster_id, count(*) AS messages, count(DISTINCT clean) AS variations_detected, pattern
    FROM (SELECT *, regexp_replace(clean, '\\p{{Nd}}+', '#', 'g') AS pattern FROM ({_CAMPAIGN_TEXT})) GROUP BY pattern HAVING count(*) >= 2"""

# Leaders in order of batch, id and fingerprint: a set of shingles leads unless an earlier leader is similar.
_SIMILAR = f"""
WITH RECURSIVE marked AS (
    SELECT doc_id % 2 AS batch, doc_id::VARCHAR AS email_id, clean, regexp_replace(clean, '\\p{{Nd}}+', '#', 'g') AS pattern FROM ({_CAMPAIGN_TEXT})
), sets AS (
    SELECT batch, sha256(pattern) AS fp, list_filter(string_split(any_value(pattern), ' '), lambda x: x <> '') AS w,
        row_number() OVER (ORDER BY batch, min(email_id), sha256(pattern)) AS n
    FROM marked GROUP BY batch, pattern
), grams AS (
    SELECT DISTINCT n, w[p : p + 4] AS g FROM (SELECT n, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM sets WHERE len(w) > 0)
), sizes AS (SELECT n, count(*) AS size FROM grams GROUP BY n),
near AS (
    SELECT b.n, list(a.n) AS before FROM (
        SELECT a.n AS x, b.n AS y, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.n < b.n GROUP BY a.n, b.n
    ) JOIN sizes a ON a.n = x JOIN sizes b ON b.n = y WHERE common >= 0.8 * (a.size + b.size - common) GROUP BY b.n
), walk AS (
    SELECT 0::BIGINT AS n, []::BIGINT[] AS leaders
    UNION ALL
    SELECT walk.n + 1, CASE WHEN len(list_intersect(coalesce(near.before, []), leaders)) = 0 THEN list_append(leaders, walk.n + 1) ELSE leaders END
    FROM walk LEFT JOIN near ON near.n = walk.n + 1 WHERE walk.n < (SELECT max(n) FROM sets)
), final AS (SELECT leaders FROM walk ORDER BY n DESC LIMIT 1),
led AS (
    SELECT sets.n, fp, batch, CASE WHEN list_contains(leaders, sets.n) THEN sets.n ELSE list_min(list_intersect(before, leaders)) END AS leader
    FROM sets, final LEFT JOIN near ON near.n = sets.n WHERE len(w) > 0
), members AS (
    SELECT email_id, leader.fp AS cluster_id, clean FROM marked m JOIN led ON led.fp = sha256(m.pattern) AND led.batch = m.batch
    JOIN sets leader ON leader.n = led.leader
)
SELECT email_id, cluster_id, count(*) OVER c AS messages, (SELECT count(DISTINCT clean) FROM members o WHERE o.cluster_id = m.cluster_id) AS variations_detected
FROM members m WINDOW c AS (PARTITION BY cluster_id)"""

# One step of the buffer: the next message of a task either joins the open episode, closes
# it (fourth type, or late but before the sweep), or finds it swept away and opens another.
_TIMEOUT, _SWEEP = 3 * DAY_MS, DAY_MS // 4
_EXPIRY = f"(ceil((s.opened_ms + {_TIMEOUT}) / {_SWEEP}::DOUBLE) * {_SWEEP})::BIGINT"
_EPISODES = f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_ms, seq) AS n FROM ({_BY_USER})),
walk AS (
    SELECT task_id, n, ts_ms, seq, analyzer_type, score, ts_ms AS opened_ms, seq AS opened_seq, [analyzer_type] AS kinds, NULL::VARCHAR AS closes
    FROM r WHERE n = 1
    UNION ALL
    SELECT task_id, n, ts_ms, seq, analyzer_type, score, opened_ms, opened_seq, kinds,
        CASE WHEN len(kinds) >= 4 THEN 'complete' WHEN ts_ms >= opened_ms + {_TIMEOUT} THEN 'partial' END AS closes
    FROM (
        SELECT r.task_id, r.n, r.ts_ms, r.seq, r.analyzer_type, r.score,
            CASE WHEN s.closes IS NOT NULL OR r.ts_ms >= {_EXPIRY} THEN r.ts_ms ELSE s.opened_ms END AS opened_ms,
            CASE WHEN s.closes IS NOT NULL OR r.ts_ms >= {_EXPIRY} THEN r.seq ELSE s.opened_seq END AS opened_seq,
            CASE WHEN s.closes IS NOT NULL OR r.ts_ms >= {_EXPIRY} THEN [r.analyzer_type]
                ELSE list_distinct(list_append(s.kinds, r.analyzer_type)) END AS kinds
        FROM walk s JOIN r ON r.task_id = s.task_id AND r.n = s.n + 1)
)
SELECT task_id, opened_ms, opened_seq, max(ts_ms) AS last_ms, coalesce(max(closes), 'timeout') AS status, count(*)::INTEGER AS n_results,
    string_agg(analyzer_type || '=' || score::DECIMAL(10,4), '|' ORDER BY ts_ms, seq) AS items
FROM walk GROUP BY task_id, opened_ms, opened_seq"""

_TABLE = f"SELECT task_id AS email_id, verdict AS overall_risk, score AS ai_assistance_score, last_ms AS decided_at FROM ({_correlated(_BY_DAY)}) WHERE complete"

_TASK_SCORES = f"""SELECT d.doc_id, k.score AS text_score, round(1 / (1 + exp(-(length(k.clean) / 1000.0::DOUBLE))), 4) AS model_score,
    h.score AS html_score, h.reason IS NOT NULL AS paged, coalesce(p.points, 0) AS link_score
    FROM (SELECT doc_id FROM ({_PHRASED}) WHERE length(text) BETWEEN 10 AND 50000) d JOIN ({_KEYWORDS}) k USING (doc_id)
    LEFT JOIN ({_HTML_SCORES}) h ON h.page_id = d.doc_id LEFT JOIN ({_LINK_SCORES}) p ON p.page_id = d.doc_id"""
_TASK_LISTS = f"SELECT doc_id, [text_score, coalesce(html_score, 0), 0, link_score]::DOUBLE[] AS scores FROM ({_TASK_SCORES})"
_MODEL_LISTS = f"SELECT doc_id, [model_score, coalesce(html_score, 0), 0, link_score]::DOUBLE[] AS scores FROM ({_TASK_SCORES})"

_HTML_DOC_REASON = "'no strong anomalous HTML structure signals'"

# Subwords: the vocabulary by line, words cut into longest pieces, a window of 256 with first, last and padding.
_CLEANED = f"SELECT doc_id, {_clean('text')} AS clean FROM documents"
_ENCODED = f"""
WITH RECURSIVE cleaned AS ({_CLEANED}),
parts AS (SELECT doc_id, regexp_extract_all(clean, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS ws FROM cleaned),
counted AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM parts) GROUP BY w),
letters AS (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM counted),
pieces AS (
    SELECT c AS p FROM letters UNION SELECT '##' || c FROM letters UNION SELECT w FROM counted WHERE n >= 20 AND length(w) > 1
    UNION SELECT '##' || e FROM (SELECT right(w, 3) AS e, sum(n) AS n FROM counted WHERE length(w) > 3 GROUP BY ALL) WHERE n >= 50
), vocabulary AS (SELECT p, row_number() OVER (ORDER BY p) + 3 AS id FROM pieces),
longest AS (SELECT max(length(p)) AS k FROM vocabulary),
cut AS (
    SELECT w, 1::BIGINT AS reached, []::BIGINT[] AS ids FROM counted
    UNION ALL
    SELECT w, reached + max(n), list_append(ids, arg_max(id, n)) FROM (
        SELECT w, reached, ids, unnest(range(1, least(length(w) - reached + 1, k) + 1)) AS n FROM cut, longest WHERE reached <= length(w)
    ) JOIN vocabulary ON p = CASE WHEN reached = 1 THEN '' ELSE '##' END || substr(w, reached, n) GROUP BY w, reached, ids
), coded AS (
    SELECT w, coalesce(any_value(ids) FILTER (reached = length(w) + 1 AND length(w) <= 100), [1]) AS ids FROM cut GROUP BY w
), told AS (
    SELECT doc_id, flatten(list(ids ORDER BY place))[1:254] AS ids
    FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM parts) JOIN coded USING (w) GROUP BY doc_id
)
SELECT doc_id, clean, [2] || coalesce(ids, []) || [3] AS ids FROM cleaned LEFT JOIN told USING (doc_id)"""

_STATUS = f"""SELECT task_id, status, CASE WHEN status = 'done' THEN verdict END AS verdict, CASE WHEN status = 'done' THEN score END AS score FROM (
        SELECT *, CASE WHEN epoch_ms(TIMESTAMP '2024-01-20') - first_ms >= 864000000 THEN 'expired' WHEN complete THEN 'done' ELSE 'processing' END AS status
        FROM ({_correlated(_BY_DAY)}))"""
_REPLAYED = f"SELECT * REPLACE (CASE WHEN status <> 'timeout' THEN items END AS items) FROM ({_EPISODES})"

ORACLES: dict[str, str] = {
    "intake_validation": """SELECT doc_id, length(text) BETWEEN 10 AND 50000 AS accepted,
        CASE WHEN length(text) < 10 THEN 'text shorter than 10 characters' WHEN length(text) > 50000 THEN 'text longer than 50000 characters' END AS rejection FROM documents""",
    "task_stamping": """SELECT doc_id, sha256(doc_id || '|' || source) AS task_id, '2024-02-01T00:00:00.000000+00:00' AS created_at
        FROM documents WHERE length(text) BETWEEN 10 AND 50000""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM ({_PHRASED})",
    "keyword_scoring": f"SELECT doc_id, hits::INTEGER AS hits, score, length(clean)::INTEGER AS clean_length FROM ({_KEYWORDS})",
    "first_nonempty_choice": """SELECT doc_id, md5(CASE WHEN lang <> 'en' THEN text ELSE source END) AS chosen FROM documents""",
    "nonblank_filter": "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND regexp_matches(text, '\\S')",
    "short_text_filter": """SELECT doc_id FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations
            UNION ALL SELECT -1 - doc_id, text FROM documents)
        WHERE length(regexp_replace('  ' || text || ' ', '^\\s+|\\s+$', '', 'g')) > 15""",
    "word_ngrams": f"SELECT doc_id, len(g)::INTEGER AS n_grams, md5(array_to_string(g, '|')) AS digest FROM ({_GRAMS % 'lower(text)'})",
    "term_statistics": _TERMS,
    "tfidf_weights": f"""SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
        SELECT doc_id, term, d.tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + v.df)) + 1) AS raw
        FROM ({_DOC_TERMS}) d JOIN ({_TERMS}) v USING (term))""",
    "text_model_scoring": f"""SELECT doc_id, length(clean)::INTEGER AS clean_length, score, (score >= 0.5)::INTEGER AS prediction,
        CASE WHEN score >= 0.8 THEN 'strong AI-generated writing patterns' WHEN score >= 0.6 THEN 'probable AI assistance in writing style'
            WHEN score >= 0.4 THEN 'mixed signals: style between human and AI' ELSE 'no strong AI-writing patterns' END AS reason,
        'stand-in' AS model_version, true AS model_available FROM (
            SELECT doc_id, clean, round(1 / (1 + exp(-(list_sum(ids) / len(ids) / 1000.0::DOUBLE))), 4) AS score FROM ({_ENCODED}))""",
    "text_encoding": f"""SELECT doc_id, 256::INTEGER AS n_ids, len(ids)::INTEGER AS n_tokens,
        md5(array_to_string(list_resize(ids, 256, 0), ',')) AS digest FROM ({_ENCODED})""",
    "text_model_fallback": f"""SELECT doc_id, length(clean)::INTEGER AS clean_length, score, (score >= 0.5)::INTEGER AS prediction,
        'heuristic fallback: trained text model is not mounted' AS reason, 'heuristic-fallback' AS model_version, false AS model_available FROM ({_KEYWORDS})""",
    "display_rows": f"""SELECT label, probability, text, count(*) AS n FROM (
        SELECT CASE WHEN p > 0.5 THEN 'AI' ELSE 'HUMAN' END AS label, {_round_half_even('p', 3)} AS probability, substr(text, 1, 70) AS text
        FROM (SELECT turn / (turn + 3)::DOUBLE AS p, text FROM conversations)) GROUP BY ALL""",
    "strip_html": "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages",
    "html_features": _HTML_FEATURES,
    "html_scoring": _HTML_SCORES,
    "link_extraction": f"SELECT page_id, position::INTEGER AS position, link FROM ({_LINKS})",
    "link_scoring": f"SELECT page_id::VARCHAR AS task_id, points::DOUBLE AS score, {_LINK_REASON} AS reason FROM ({_LINK_SCORES})",
    "image_payloads": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE strlen(text) END::INTEGER AS n_bytes,
        sha256(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END) AS sha256 FROM documents""",
    "image_headers": f"""SELECT doc_id, CASE WHEN turn >= 2 THEN 'PNG' END AS format, CASE WHEN turn >= 2 THEN (doc_id + 1)::INTEGER END AS width,
        CASE WHEN turn >= 2 THEN n_chars::INTEGER END AS height FROM ({_PNG})""",
    "image_scoring": f"""SELECT doc_id, CASE WHEN turn >= 2 THEN 'PNG' END AS format, CASE WHEN turn = 3 THEN 'Author' ELSE '' END AS keys,
        (CASE WHEN turn < 2 THEN 0 ELSE CASE WHEN turn = 2 THEN 0.10 ELSE 0 END + CASE WHEN qr THEN 0.25 ELSE 0 END END)::DOUBLE AS score,
        CASE WHEN turn = 0 THEN 'no image payload' WHEN turn = 1 THEN 'image could not be decoded' WHEN qr THEN 'QR code detected'
            ELSE 'no QR code detected; AI-image score is heuristic' END AS reason FROM ({_PNG})""",
    "image_formats": """SELECT doc_id, v.format, CASE WHEN v.format IS NOT NULL THEN doc_id % 16000 + 1 END::INTEGER AS width,
        CASE WHEN v.format IS NOT NULL THEN n_chars % 16000 + 1 END::INTEGER AS height, v.mode, v.keys, v.format IS NULL AS decode_error
        FROM documents JOIN (VALUES (0, 'GIF', 'P', 'version'), (1, 'BMP', 'RGB', 'compression|dpi'), (2, 'WEBP', 'RGB', 'background|loop'),
            (3, 'WEBP', 'RGBA', 'background|loop'), (4, 'WEBP', 'RGB', 'background|exif|icc_profile|loop|xmp'),
            (5, 'TIFF', 'L', 'compression|icc_profile'), (6, 'TIFF', 'L', 'compression|icc_profile'), (7, 'JPEG', 'RGB', 'comment'),
            (8, 'PNG', 'RGB', ''), (9, NULL, NULL, NULL)) v(kind, format, mode, keys) ON doc_id % 10 = v.kind""",
    "mail_parsing": """SELECT doc_id, 'Тема ' || doc_id AS subject, 'sender' || doc_id || '@example.com' AS from_addr, 'box@example.org' AS to_addr,
        '<' || doc_id || '@example.com>' AS message_id, md5(text || chr(10) || 'http://example.com/' || doc_id) AS text_digest,
        '<p><a href="https://example.org/' || doc_id || '">x</a></p>' AS html_body, 2::INTEGER AS n_links, 1::INTEGER AS n_attachments,
        'sender' || doc_id || '@example.com' AS from_header FROM documents""",
    "mail_links": """SELECT doc_id, 0::INTEGER AS position, 'https://example.org/' || doc_id AS link FROM documents
        UNION ALL SELECT doc_id, 1, 'http://example.com/' || doc_id FROM documents""",
    "mail_attachments": """SELECT doc_id, 'data.bin' AS filename, 'application/octet-stream' AS content_type, strlen(source)::BIGINT AS size,
        sha256(source) AS sha256 FROM documents""",
    "attachment_facts": "SELECT doc_id, strlen(text)::INTEGER AS size, sha256(text) AS sha256 FROM documents",
    "folder_labels": """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE 1 END::INTEGER AS label, 'human' AS source, 0::INTEGER AS ai_assisted
        FROM documents WHERE doc_id % 4 <> 2""",
    "decoded_results": f"""SELECT seq, value->>'task_id' AS task_id, coalesce(value->>'analyzer_type', split_part(topic, '.', -1)) AS analyzer_type,
        (value->>'score')::DOUBLE AS score, replace((value->'features')::VARCHAR, ' ', '') AS features FROM ({_VALID}) WHERE value->>'task_id' <> ''""",
    "dead_letters": f"""SELECT topic, 'deserialization failed: not a JSON object' AS error, value AS raw, count(*) AS n FROM ({_MESSAGES})
        WHERE NOT (json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT') GROUP BY ALL""",
    "skipped_tasks": f"SELECT value->>'task_id' AS task_id, count(*) AS n FROM ({_VALID}) GROUP BY 1",
    "contract_check": f"""SELECT seq, CASE WHEN analyzer_type = 'error' THEN 'unknown analyzer' ELSE 'score outside 0..1' END AS violation
        FROM ({_BY_DAY}) WHERE analyzer_type = 'error' OR NOT score * 1.5::DOUBLE BETWEEN 0 AND 1""",
    "contract_strict_results": f"""SELECT seq, analyzer_type, score * 1.5::DOUBLE AS score FROM ({_BY_DAY})
        WHERE analyzer_type <> 'error' AND score * 1.5::DOUBLE BETWEEN 0 AND 1""",
    "message_dedup": f"SELECT task_id, analyzer_type, score, min(ts_ms) AS ts_ms, arg_min(seq, ts_ms) AS seq FROM ({_BY_DAY}) GROUP BY task_id, analyzer_type, score, props, event_type, ts",
    "task_correlation": f"SELECT task_id, analyzer_count, n_types, complete, first_ms, last_ms, score, verdict FROM ({_correlated(_BY_DAY)})",
    "arrival_positions": f"SELECT task_id, seq, row_number() OVER (PARTITION BY task_id ORDER BY ts_ms, seq) AS position FROM ({_BY_USER})",
    "nested_results": f"""SELECT task_id, ((position - 1) // 10)::INTEGER AS chunk, count(*)::INTEGER AS n,
        string_agg(analyzer_type || '=' || score::DECIMAL(10,4), '|' ORDER BY position) AS items FROM (
            SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_ms, seq) AS position FROM ({_BY_USER})) GROUP BY 1, 2""",
    "first_arrivals": f"""SELECT *, coalesce(filled_ms < deadline_ms, false) AS in_time FROM (
        SELECT task_id, min(ts_ms) AS first_ms, min(ts_ms) + {_TIMEOUT} AS deadline_ms,
            min(ts_ms) FILTER (types_seen = 4) AS filled_ms, max(types_seen)::INTEGER AS n_types FROM (
            SELECT task_id, ts_ms, row_number() OVER (PARTITION BY task_id ORDER BY ts_ms, analyzer_type) AS types_seen FROM (
                SELECT task_id, analyzer_type, min(ts_ms) AS ts_ms FROM ({_BY_USER}) GROUP BY 1, 2)) GROUP BY task_id)""",
    "task_verdicts": f"""SELECT task_id, verdict, rounded AS score, len(scores)::INTEGER AS analyzer_count,
        array_to_string(list_transform(scores[1:10], lambda s: s::DECIMAL(10,4)::VARCHAR), '|') AS individual_scores,
        '2024-02-01T00:00:00.000000+00:00' AS decided_at FROM ({_decided(_BY_USER)})""",
    "verdict_reasons": f"""SELECT task_id, chunk, string_agg(analyzer_type || ': ' || CASE WHEN score > 0.5 THEN '{V.REASON_SUSPICIOUS}' ELSE '{V.REASON_CLEAN}' END
        || ' (score=' || score::VARCHAR || ')', '|' ORDER BY ts_ms, seq) AS reasons FROM (
            SELECT *, ((row_number() OVER (PARTITION BY task_id ORDER BY ts_ms, seq) - 1) // 10)::INTEGER AS chunk FROM ({_BY_USER}))
        GROUP BY task_id, chunk""",
    "verdict_rows": f"""SELECT task_id AS email_id, verdict AS overall_risk, rounded AS ai_assistance_score, verdict AS classification,
        NULL::VARCHAR AS cluster_id, verdict AS blob_verdict, len(scores)::INTEGER AS blob_count, '2024-02-01 00:00:00' AS decided_at FROM ({_decided(_BY_USER)})""",
    "out_of_scale_letters": f"""SELECT task_id, 'mean score outside the verdict scale' AS reason, '2024-02-01T00:00:00.000000+00:00' AS at
        FROM ({_decided(f'SELECT task_id, analyzer_type, score * 2.25::DOUBLE AS score, ts_ms, seq FROM ({_BY_USER})')}) WHERE mean >= 1.1""",
    "latest_verdicts": f"{_TABLE} ORDER BY decided_at DESC, email_id LIMIT 5",
    "verdict_lookup": f"SELECT * FROM ({_TABLE}) WHERE email_id = (SELECT min(email_id) FROM ({_TABLE}))",
    "task_status": _STATUS,
    "stream_task_status": _STATUS,
    "contract_verdicts": f"""SELECT v.task_id AS email_id, verdict AS overall_risk, rounded AS ai_assistance_score, n_signals::INTEGER AS n_signals, text_signal,
        coalesce(rules, '') AS rules, 0::INTEGER AS variations, '0.1.0' AS model_version FROM ({_decided(_BY_USER)}) v JOIN (
            SELECT task_id, count(DISTINCT analyzer_type) AS n_signals,
                (list(score ORDER BY ts_ms DESC, seq DESC) FILTER (analyzer_type = 'text'))[1]::DECIMAL(10,4)::VARCHAR AS text_signal,
                array_to_string(list_sort(list(DISTINCT analyzer_type) FILTER (score > 0.5)), '|') AS rules
            FROM ({_BY_USER}) GROUP BY task_id) s ON s.task_id = v.task_id""",
    "message_envelopes": """SELECT sha256('parser|' || doc_id || '|' || payload) AS message_id, doc_id::VARCHAR AS email_id, '1.0' AS schema_version,
        'parser' AS producer, payload, '2024-02-01T00:00:00.000000+00:00' AS produced_at FROM (
            SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' AS payload FROM documents)""",
    "replayed_episodes": _REPLAYED,
    "replayed_episodes_split": _REPLAYED,
    "timeout_letters": f"""SELECT task_id, 'aggregation timeout' AS reason, strftime(make_timestamp((opened_ms + {_TIMEOUT}) * 1000), '%Y-%m-%dT%H:%M:%S') AS at
        FROM ({_EPISODES}) WHERE status = 'timeout'""",
    "branch_union": f"""SELECT task_id, n::INTEGER AS analyzer_count, types::INTEGER AS n_types, types >= 4 AS complete,
        {_round_half_even('mean', 3)} AS score, {_verdict('mean')} AS verdict FROM (
            SELECT task_id, count(*) AS n, count(DISTINCT kind) AS types, sum(score::VARCHAR::DECIMAL(28,18))::VARCHAR::DOUBLE / count(*) AS mean FROM (
                SELECT doc_id::VARCHAR AS task_id, 'text' AS kind, score FROM ({_KEYWORDS})
                UNION ALL SELECT page_id::VARCHAR, 'html', score FROM ({_HTML_SCORES})
                UNION ALL SELECT page_id::VARCHAR, 'images', 0 FROM pages
                UNION ALL SELECT page_id::VARCHAR, 'links-meta', CASE WHEN mismatch THEN 0.5 ELSE 0 END FROM ({_LINK_SCORES})) GROUP BY task_id)""",
    "message_verdicts": f"""SELECT doc_id::VARCHAR AS task_id, {_verdict('mean')} AS verdict, {_round_half_even('mean', 3)} AS score, 4::INTEGER AS analyzer_count,
        array_to_string(list_transform(scores, lambda s: s::DECIMAL(10,4)::VARCHAR), '|') AS individual_scores
        FROM (SELECT *, {_mean('scores')} AS mean FROM ({_TASK_LISTS}))""",
    "model_verdicts": f"""SELECT doc_id::VARCHAR AS task_id, {_verdict('mean')} AS verdict, {_round_half_even('mean', 3)} AS score, 4::INTEGER AS analyzer_count,
        array_to_string(list_transform(scores, lambda s: s::DECIMAL(10,4)::VARCHAR), '|') AS individual_scores
        FROM (SELECT *, {_mean('scores')} AS mean FROM ({_MODEL_LISTS}))""",
    "corpus_union": f"""SELECT count(*) AS total, count(*) FILTER (label = 1) AS spam, count(*) FILTER (label = 0) AS ham,
        count(*) FILTER (ai_assisted = 1) AS ai_assisted, count(*) FILTER (ai_assisted = 0) AS human
        FROM (SELECT label, ai_assisted FROM ({_LABELLED}) UNION ALL SELECT label, ai_assisted FROM ({_TURNS}))""",
    "text_dedup": "SELECT min(doc_id) AS seq, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text",
    "split_by_hash": f"""SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT doc_id, {_unit('42', 'doc_id')} AS u FROM ({_LABELLED}))""",
    "split_exact": f"""SELECT doc_id, label, CASE WHEN n - 1 < floor(size * 0.8::DOUBLE + 0.5) THEN 'train' ELSE 'test' END AS split FROM (
        SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY u, doc_id) AS n, count(*) OVER (PARTITION BY label) AS size
        FROM (SELECT doc_id, label, {_unit('42', 'doc_id')} AS u FROM ({_LABELLED})))""",
    "shuffled_corpus": "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || text), doc_id) AS position FROM documents",
    "softmax_scores": """SELECT vec_id, best, round(p1, 9) AS p1, CASE WHEN p >= 0.8 THEN 'strong AI-generated writing patterns'
        WHEN p >= 0.6 THEN 'probable AI assistance in writing style' WHEN p >= 0.4 THEN 'mixed signals: style between human and AI' ELSE 'no strong AI-writing patterns' END AS reason FROM (
            SELECT vec_id, (list_position(e, list_max(e)) - 1)::INTEGER AS best,
                exp(e[2] - list_max(e)) / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))) AS p1,
                1 / (1 + exp(list_sum(list_filter(e, lambda x, i: i % 2 = 1)) - list_sum(list_filter(e, lambda x, i: i % 2 = 0)))) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
    "accuracy_precision_recall": f"""SELECT n, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
        round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM (
            SELECT count(*) AS n, count(*) FILTER (label = prediction) / count(*)::DOUBLE AS accuracy,
                count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (prediction = 1))::DOUBLE AS precision,
                count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (label = 1))::DOUBLE AS recall FROM ({_RATED}))""",
    "area_under_curve": """SELECT round(sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 9) AS roc_auc FROM
        (SELECT round(n_chars / 1000.0::DOUBLE, 1) AS score FROM documents JOIN labels USING (doc_id) WHERE quality = 0) p,
        (SELECT round(n_chars / 1000.0::DOUBLE, 1) AS score FROM documents JOIN labels USING (doc_id) WHERE quality = 1) q""",
    "classification_report": f"""WITH c AS ({_PER_CLASS}), a AS (SELECT count(*) FILTER (label = prediction) / count(*)::DOUBLE AS x, count(*) AS n FROM ({_RATED}))
        SELECT class::VARCHAR AS class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM c
        UNION ALL SELECT 'accuracy', round(x, 9), round(x, 9), round(x, 9), n FROM a
        UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM c
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
            round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM c""",
    "confusion_counts": f"SELECT label, prediction, count(*) AS n FROM ({_RATED}) GROUP BY ALL",
    "class_weights": """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 9) AS weight
        FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""",
    "message_campaigns": _CAMPAIGNS,
    "campaign_members": f"""SELECT doc_id::VARCHAR AS email_id, c.cluster_id, c.variations_detected, c.pattern
        FROM ({_CAMPAIGN_TEXT}) m JOIN ({_CAMPAIGNS}) c ON c.pattern = regexp_replace(m.clean, '\\p{{Nd}}+', '#', 'g')""",
    "similar_campaigns": _SIMILAR,
    "template_filling": f"""SELECT doc_id, source || ': order ' || n || ' in ' || d || ' hours, ' || c || '; again ' || n AS text FROM (
        SELECT doc_id, source, (floor({_unit('42:n', 'doc_id')} * 99900)::INTEGER + 100) AS n,
            ['12', '24', '48', '72', '3', '7', '14'][floor({_unit('42:d', 'doc_id')} * 7)::INTEGER + 1] AS d,
            ['Банк', 'Магазин', 'Сервис', 'Онлайн', 'Маркет'][floor({_unit('42:company', 'doc_id')} * 5)::INTEGER + 1] AS c FROM documents)""",
    "stream_scoring": f"""SELECT doc_id::VARCHAR AS task_id, unnest(['text', 'html', 'images', 'links-meta']) AS analyzer_type,
        unnest([score, 0, 0, 0]::DOUBLE[]) AS score,
        unnest(['heuristic fallback: trained text model is not mounted', {_HTML_DOC_REASON}, 'no image payload', 'no suspicious links']) AS reason
        FROM ({_KEYWORDS})""",
    "stream_verdicts": f"""SELECT doc_id::VARCHAR AS task_id, {_verdict('mean')} AS verdict, {_round_half_even('mean', 3)} AS score, 4::INTEGER AS analyzer_count
        FROM (SELECT doc_id, {_mean('scores')} AS mean FROM (SELECT doc_id, [score, 0, 0, 0]::DOUBLE[] AS scores FROM ({_KEYWORDS})))""",
    "stream_aggregation": f"SELECT task_id, opened_ms, last_ms, status, n_results, CASE WHEN status <> 'timeout' THEN items END AS items FROM ({_EPISODES})",
}
