"""Expected results of the registered queries as SQL over the same tables.

Where a query derives its input, the SQL states the outcome from the rule that made the
input, and does not read the derived pages again.
"""

from __future__ import annotations

# Strings of the characters that stripping removes, as SQL.
_WS = "||".join(
    f"chr({code})"
    for code in (
        *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_HTTPS = "url LIKE 'https://%'"


def _strip(value: str) -> str:
    return f"trim({value}, {_WS})"


_HOSTS = f"hosts AS (SELECT DISTINCT {_HOST} AS host FROM pages)"
_PROFILES = f"""{_HOSTS}, profiles AS (
    SELECT host, 's' || substr(md5(host), 1, 12) AS source,
        length(host) % 3 <> 0 AS enabled, length(host) % 5 = 0 AS adapted FROM hosts)"""

# The sixteen page shapes: expected reason and fields.
_SHAPES = f"""docs AS (
    SELECT *, doc_id % 16 AS shape,
        trim(regexp_replace(text, '[\\x00-\\x20\\x7f]+', ' ', 'g'), ' ') AS flat,
        'https://www.' || source || '.example/' AS site,
        make_timestamp((1704067200 + doc_id * 61) * 1000000::BIGINT) AS instant
    FROM documents),
judged AS (
    SELECT *, CASE
        WHEN doc_id % 25 = 24 THEN 'robots_disallowed'
        WHEN shape = 7 THEN 'no_candidate'
        WHEN shape = 8 THEN 'candidate_ambiguous'
        WHEN shape = 9 THEN 'candidate_no_match'
        WHEN shape = 10 THEN 'canonical_out_of_bounds'
        WHEN shape = 11 THEN 'headline_missing'
        WHEN shape = 12 THEN 'published_missing'
        WHEN shape = 14 THEN 'article_invalid'
        WHEN shape = 13 AND regexp_matches({_strip('text')}, '[\\x00-\\x1f\\x7f]') THEN 'article_invalid'
        END AS reason
    FROM docs)"""
_PUBLISHED = """strftime(instant, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN doc_id % 3 = 0 THEN '.250000' ELSE '' END || '+00:00'"""
_DESCRIPTION = f"nullif({_strip('CASE WHEN shape = 13 THEN text ELSE flat END')}, '')"
_STAGE = """CASE reason WHEN 'robots_disallowed' THEN 'robots' WHEN 'no_candidate' THEN 'parse'
    WHEN 'candidate_ambiguous' THEN 'select' WHEN 'candidate_no_match' THEN 'select'
    WHEN 'canonical_out_of_bounds' THEN 'canonical' WHEN 'headline_missing' THEN 'fields'
    WHEN 'published_missing' THEN 'fields' WHEN 'article_invalid' THEN 'contract' END"""
_REQUESTED = """site || CASE WHEN doc_id % 25 = 24 THEN 'closed/' ELSE 'r/' END || doc_id"""

_ATTEMPTS = """attempts AS (
    SELECT event_id // 4 AS request_id, event_id % 4 + 1 AS attempt_no,
        CASE WHEN (event_id // 4) % 3 = 0 THEN 1 ELSE 3 END AS allowed,
        CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'error' THEN 503
            WHEN 'signup' THEN 429 END AS status,
        CASE WHEN event_type = 'purchase' THEN user_id % 2 = 0 END AS transient,
        ts
    FROM events)"""
_ENDINGS = """counted AS (SELECT * FROM attempts WHERE attempt_no <= allowed),
endings AS (
    SELECT request_id, attempt_no, CASE
        WHEN transient AND attempt_no < allowed THEN NULL
        WHEN transient IS NOT NULL THEN 'request_error'
        WHEN status IN (408, 429, 500, 502, 503, 504) THEN
            CASE WHEN attempt_no = allowed THEN 'response_retry_exhausted' END
        ELSE 'response' END AS outcome, status
    FROM counted),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY outcome IS NULL, attempt_no) AS rank,
        max(attempt_no) OVER (PARTITION BY request_id) AS seen
    FROM endings)
SELECT request_id, coalesce(CASE WHEN outcome IS NOT NULL THEN attempt_no END, seen)::INTEGER AS attempts_used,
    coalesce(outcome, 'incomplete') AS outcome,
    CASE WHEN outcome IS NOT NULL THEN status END AS final_status,
    CASE coalesce(CASE WHEN outcome IS NOT NULL THEN attempt_no END, seen)
        WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS total_backoff
FROM ranked WHERE rank = 1"""

_RULE_OF_PAGE = f"""CASE length({_ORIGIN}) % 5
    WHEN 0 THEN NULL
    WHEN 1 THEN 'robots_disallowed'
    WHEN 4 THEN 'robots_status_unsupported'
    WHEN 2 THEN CASE WHEN {_PATH} LIKE '/en/%' THEN 'robots_disallowed' END
    ELSE CASE WHEN {_PATH} LIKE '/de/%' THEN NULL
              WHEN {_PATH} LIKE '/de%' OR {_PATH} LIKE '/es/%' THEN 'robots_disallowed' END
    END"""

_RESPONSE = """response AS (
    SELECT doc_id, text, octet_length(encode(text)) + CASE WHEN doc_id % 20 = 10 THEN 1 ELSE 0 END AS bytes,
        length(text) AS chars, doc_id % 20 = 10 AS spoiled,
        octet_length(encode(text)) = length(text) AND doc_id % 20 <> 10 AS plain,
        regexp_matches(hex(encode(text)), '^(..)*(81|8D|8F|90|9D)') AS undefined,
        CASE WHEN doc_id % 11 = 0 THEN 404 WHEN doc_id % 11 = 1 THEN 500
             WHEN doc_id % 11 = 2 THEN 204 ELSE 200 END AS status,
        CASE WHEN doc_id % 13 = 12 THEN -1 ELSE doc_id % 10 END AS header,
        doc_id % 19 = 18 AS missing
    FROM documents),
judged AS (
    SELECT *, CASE
        WHEN missing THEN 'request_error'
        WHEN status NOT BETWEEN 200 AND 299 THEN 'response_status'
        WHEN header = -1 THEN 'content_type_missing'
        WHEN header IN (4, 9) THEN 'content_type_unsupported'
        WHEN header IN (0, 1, 2, 3) AND spoiled THEN 'decoding_failed'
        WHEN header = 6 AND undefined THEN 'decoding_failed'
        WHEN header = 7 AND NOT plain THEN 'decoding_failed'
        WHEN header = 8 THEN 'decoding_failed' END AS reason
    FROM response)"""

_KEYS = (
    "access_token|api-key|api_key|apikey|authorization|client_secret|cookie|password|passwd|"
    "proxy-authorization|refresh_token|secret|set-cookie|token"
)

ORACLES: dict[str, str] = {
    "request_table": f"""
        SELECT page_id AS position,
            CASE WHEN page_id % 17 = 0 THEN ' ' || chr(9) || chr(13) || chr(10) ELSE url END AS url,
            CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
            'daily' AS batch,
            CASE WHEN page_id % 17 = 0 THEN 'request_url_blank' END AS request_reason
        FROM pages""",
    "url_parts": f"""
        SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {_HOST} AS host,
            {_PATH} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query,
            regexp_extract(url, '#(.*)$', 1) AS fragment, {_ORIGIN} AS origin
        FROM pages""",
    "https_boundary": f"""
        SELECT page_id, NULL::VARCHAR AS target_reason,
            CASE WHEN {_HTTPS} THEN {_HOST} END AS resolvable,
            {_HTTPS} AS requested_ok,
            {_HTTPS} AND NOT regexp_matches(url, '#.') AS canonical_ok,
            CASE WHEN {_HTTPS} AND NOT regexp_matches(url, '#.') AND length({_HOST}) % 2 = 0
                THEN NULL ELSE 'canonical_out_of_bounds' END AS page_reason
        FROM pages""",
    "fetch_targets": """
        SELECT page_id, form, reason FROM pages, (VALUES ('whole', NULL), ('no_scheme', 'target_url_incomplete'),
            ('no_host', 'target_url_incomplete'), ('open_bracket', 'target_url_malformed'),
            ('bad_port', 'target_url_malformed'), ('worded_port', 'target_url_malformed'),
            ('inner_blank', 'target_url_incomplete')) f(form, reason)""",
    "host_rules_table": f"""
        WITH {_HOSTS}
        SELECT upper(host) || '..' AS given, host AS profile_form, host AS article_form,
            host AS parser_form FROM hosts
        UNION ALL SELECT ' ' || host, NULL, host, host FROM hosts
        UNION ALL SELECT host || '.local', NULL, host || '.local', host || '.local' FROM hosts
        UNION ALL SELECT host || ':443', NULL, NULL, NULL FROM hosts
        UNION ALL SELECT 'my_' || host, NULL, NULL, NULL FROM hosts
        UNION ALL SELECT split_part(host, '.', 1), NULL, NULL, NULL FROM hosts
        UNION ALL SELECT '10.0.0.' || (length(host) % 256), NULL, NULL,
            '10.0.0.' || (length(host) % 256) FROM hosts
        UNION ALL SELECT 'bücher.' || host, 'xn--bcher-kva.' || host, NULL, NULL FROM hosts""",
    "source_resolution": f"""
        WITH {_PROFILES}
        SELECT CASE WHEN NOT {_HTTPS} THEN 'source_unresolved' WHEN NOT enabled THEN 'source_disabled'
            WHEN adapted THEN 'source_adapter_unsupported' ELSE 'resolved' END AS outcome,
            count(*) AS pages
        FROM pages LEFT JOIN profiles ON host = {_HOST} GROUP BY 1""",
    "profile_lookups": f"""
        WITH {_PROFILES}
        SELECT page_id, CASE WHEN {_HTTPS} AND enabled THEN source END AS by_url,
            CASE WHEN enabled THEN source END AS by_host,
            CASE WHEN enabled AND page_id % 2 = 0 THEN source END AS by_source
        FROM pages LEFT JOIN profiles ON host = {_HOST}""",
    "unresolved_pages": f"""
        SELECT page_id, url FROM pages WHERE NOT {_HTTPS} OR length({_HOST}) % 3 = 0""",
    "profile_conflicts": f"""
        WITH {_PROFILES}
        SELECT 'source' AS kind, source AS value, 2::BIGINT AS claims FROM profiles WHERE length(host) % 4 = 0
        UNION ALL SELECT 'host', host, 2 FROM profiles WHERE length(host) % 7 = 0
        UNION ALL SELECT 'host', 'alt.' || host, 2 FROM profiles WHERE length(host) % 7 = 0""",
    "profile_validation": f"""
        WITH {_PROFILES}
        SELECT source AS key, CASE length(host) % 8 WHEN 0 THEN 'source_invalid'
            WHEN 1 THEN 'source_invalid' WHEN 2 THEN 'domains_invalid' WHEN 3 THEN 'domains_invalid'
            WHEN 4 THEN 'family_invalid' WHEN 5 THEN 'adapter_key_invalid' END AS reason,
            CASE length(host) % 8 WHEN 0 THEN 'https://x.example/' WHEN 2 THEN ''
            WHEN 3 THEN 'localhost' ELSE host || '|alt.' || host END AS domains
        FROM profiles""",
    "profile_dispatch": f"""
        WITH {_PROFILES}
        SELECT source, host AS primary_domain, true AS supports_own, false AS supports_sub,
            CASE WHEN NOT enabled THEN 'source_disabled'
                WHEN adapted THEN 'source_adapter_unsupported' END AS reason,
            '{{"source":"' || source || '","domains":["' || host || '","alt.' || host
            || '"],"parser_family":"jsonld_article","adapter_key":'
            || CASE WHEN adapted THEN '"custom"' ELSE 'null' END
            || ',"enabled":' || CASE WHEN enabled THEN 'true' ELSE 'false' END || '}}' AS record
        FROM profiles""",
    "robots_origins": f"""
        SELECT {_ORIGIN} AS origin, count(*) AS pages, {_ORIGIN} || '/robots.txt' AS robots_url
        FROM pages GROUP BY 1""",
    "robots_snapshot": f"""
        WITH origins AS (SELECT DISTINCT {_ORIGIN} AS origin FROM pages)
        SELECT origin, CASE length(origin) % 5 WHEN 0 THEN 'allow_all' WHEN 1 THEN 'deny_all'
            WHEN 4 THEN 'error' ELSE 'rules' END AS policy,
            CASE WHEN length(origin) % 5 = 4 THEN 'robots_status_unsupported' END AS reason,
            CASE length(origin) % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS groups,
            CASE length(origin) % 5 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS rules
        FROM origins""",
    "robots_decisions": f"SELECT page_id, {_RULE_OF_PAGE} AS robots_reason FROM pages",
    "attempt_outcomes": f"WITH {_ATTEMPTS}, {_ENDINGS}",
    "unnumbered_attempts": f"""
        WITH {_ATTEMPTS.replace('attempts AS', 'logged AS')},
        attempts AS (SELECT * REPLACE (
            row_number() OVER (PARTITION BY request_id ORDER BY ts) AS attempt_no) FROM logged),
        {_ENDINGS}""",
    "backoff_schedule": f"""
        WITH {_ATTEMPTS}
        SELECT request_id, attempt_no::INTEGER AS attempt_no,
            CASE WHEN attempt_no = 1 THEN 0.0::DOUBLE
                ELSE least(0.5 * pow(2, attempt_no - 2), 8.0)::DOUBLE END AS delay,
            CASE WHEN attempt_no = 1 THEN 0.0::DOUBLE
                ELSE least(1.0 * pow(2, attempt_no - 2), 3.0)::DOUBLE END AS short_delay,
            coalesce(status IN (408, 429, 500, 502, 503, 504), false) AS retry_status,
            allowed > 1 AS retry_method
        FROM attempts""",
    "identity_audit": f"""
        WITH {_HOSTS}, built AS (
            SELECT host, length(host) % 8 AS kind,
                CASE length(host) % 8 WHEN 0 THEN 'My Agent' WHEN 1 THEN 'xGoogleBot'
                    ELSE 'Agent-' || length(host) END
                || '/' || CASE WHEN length(host) % 8 = 2 THEN '' ELSE '1.2' END
                || ' (+' || CASE length(host) % 8 WHEN 3 THEN 'http://' || host
                    WHEN 4 THEN 'https://' || host || '/?q=1' ELSE 'https://' || host || '/about' END
                || coalesce('; contact=' || CASE length(host) % 8 WHEN 5 THEN 'https://10.0.0.1/'
                    WHEN 6 THEN 'https://' || host || '/' || repeat('c', 240)
                    WHEN 7 THEN 'https://' || host || '/c' END, '') || ')' AS user_agent
            FROM hosts)
        SELECT host, user_agent, CASE kind WHEN 0 THEN 'product_name_invalid'
            WHEN 1 THEN 'product_name_imitates' WHEN 2 THEN 'product_version_invalid'
            WHEN 3 THEN 'project_url_invalid' WHEN 4 THEN 'project_url_invalid'
            WHEN 5 THEN 'contact_invalid' WHEN 6 THEN 'user_agent_too_long' END AS identity_reason
        FROM built""",
    "identity_agreement": f"""
        WITH seen AS (
            SELECT {_ORIGIN} AS origin, 'page' AS side,
                CASE WHEN page_id % 40 = 0 THEN 'Other/2' ELSE 'Agent/1' END AS agent FROM pages
            UNION ALL
            SELECT {_ORIGIN}, 'robots',
                CASE WHEN length({_ORIGIN}) % 9 = 0 THEN 'Other/2' ELSE 'Agent/1' END
            FROM pages WHERE length({_ORIGIN}) % 4 > 0)
        SELECT origin, count(DISTINCT agent) FILTER (side = 'page') AS page_agents,
            count(DISTINCT agent) FILTER (side = 'robots') AS robots_agents,
            count(DISTINCT agent) AS agents
        FROM seen GROUP BY 1
        HAVING page_agents > 0 AND robots_agents > 0 AND agents > 1""",
    "capture_filter": f"""
        WITH {_RESPONSE}
        SELECT doc_id AS position, reason,
            CASE WHEN reason IS NULL THEN CASE header WHEN 5 THEN 'iso8859-1' WHEN 6 THEN 'cp1252'
                WHEN 7 THEN 'ascii' ELSE 'utf-8' END END AS encoding,
            CASE WHEN reason IS NULL THEN CASE WHEN header IN (5, 6) THEN bytes ELSE chars END
                END AS content_chars,
            CASE WHEN NOT missing THEN 0.0::DOUBLE END AS elapsed
        FROM judged""",
    "response_items": f"""
        WITH {_RESPONSE},
        steps AS (SELECT r.*, item_pos FROM response r, (VALUES (0), (1), (2)) p(item_pos)
            WHERE status <> 404 AND NOT (status = 500 AND item_pos = 2))
        SELECT doc_id AS position, item_pos,
            CASE item_pos WHEN 0 THEN 'status' WHEN 1 THEN CASE WHEN status <> 500 THEN 'bytes' END
                ELSE CASE WHEN status = 200 THEN CASE header WHEN 0 THEN 'text/html; charset=utf-8'
                    WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/html;level="1";charset="utf-8"'
                    WHEN 3 THEN 'application/xhtml+xml; charset=' WHEN 4 THEN 'application/json'
                    WHEN 5 THEN 'text/html; charset=iso-8859-1' WHEN 6 THEN 'text/html; charset=windows-1252'
                    WHEN 7 THEN 'text/html; charset=us-ascii' WHEN 8 THEN 'text/html; charset=nope'
                    WHEN 9 THEN 'html' END END END AS label,
            CASE item_pos WHEN 0 THEN status WHEN 1 THEN CASE WHEN status <> 500 THEN bytes END
                ELSE CASE WHEN status = 200 AND header >= 0 THEN 2 END END AS size,
            CASE WHEN item_pos = 1 AND status = 500 THEN 'response_status'
                WHEN item_pos = 2 AND status = 204 THEN 'parser_contract'
                WHEN item_pos = 2 AND header = -1 THEN 'parser_execution' END AS reason_code
        FROM steps""",
    "seed_resolution": """
        WITH places AS (SELECT source, 2 + row_number() OVER (ORDER BY crc) AS line
            FROM (SELECT DISTINCT source, ('0x' || substr(md5(source), 1, 7))::BIGINT AS crc FROM documents)),
        planted AS (SELECT doc_id, source, doc_id % 5 AS kind FROM documents)
        SELECT doc_id, CASE kind WHEN 0 THEN 'cnn_indonesia' WHEN 1 THEN 'kompas' WHEN 4 THEN p.source END AS source,
            CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN places.line END AS line,
            CASE kind WHEN 1 THEN 'source_disabled' WHEN 2 THEN 'source_unresolved'
                WHEN 3 THEN 'source_unresolved' ELSE 'resolved' END AS outcome
        FROM planted p JOIN places USING (source)""",
    "head_fallbacks": f"""
        WITH {_SHAPES},
        heads AS (SELECT *, doc_id % 8 AS head, CASE WHEN doc_id % 25 = 24 THEN 'robots_disallowed'
            WHEN doc_id % 9 = 8 THEN 'published_missing' END AS stopped FROM docs)
        SELECT doc_id AS position, stopped AS reason_code,
            CASE WHEN stopped IS NULL THEN strftime(instant, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published_at,
            CASE WHEN stopped IS NULL AND head IN (1, 6) THEN '2024-06-01T00:00:00+00:00' END AS modified_at,
            CASE WHEN stopped IS NULL AND head IN (1, 2, 3, 7) THEN
                CASE WHEN flat = '' AND head = 1 THEN 'Last choice' ELSE nullif({_strip('flat')}, '') END END AS description,
            CASE WHEN stopped IS NULL AND head IN (4, 5) THEN 'https://img.example.org/h/' || doc_id || '.jpg' END AS lead_image_url
        FROM heads""",
    "ordered_export": f"""
        SELECT doc_id AS position, {_REQUESTED} AS url, row_number() OVER (ORDER BY doc_id) AS line, TRUE AS in_bounds
        FROM (SELECT *, 'https://www.' || source || '.example/' AS site FROM documents)""",
    "page_language": """
        SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, count(*) AS pages
        FROM pages GROUP BY 1""",
    "first_metadata": """
        SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY 1, 2""",
    "article_extract": f"""
        WITH {_SHAPES}
        SELECT doc_id AS position, source, 'www.' || source || '.example' AS source_domain,
            {_REQUESTED} AS requested_url, site || 'a/' || doc_id AS canonical_url,
            {_strip("'No. ' || doc_id || ': ' || left(flat, 60)")} AS headline,
            {_PUBLISHED} AS published_at, {_DESCRIPTION} AS description,
            CASE WHEN shape = 15 THEN 'Ann Lee|Bo <i>' WHEN doc_id % 3 = 1 THEN 'Desk ' || source
                WHEN doc_id % 3 = 2 THEN 'Ann Lee' ELSE '' END AS author_names,
            CASE WHEN shape = 2 THEN '2024-06-01T02:30:00+00:00' END AS modified_at,
            CASE WHEN n_chars % 4 > 0 THEN 'Part ' || (n_chars % 4) END AS section,
            CASE WHEN shape IN (0, 1) THEN 'https://img.example.org/' || doc_id || '.jpg' END
                AS lead_image_url,
            CASE WHEN shape = 15 THEN 'en-US' ELSE lang END AS language
        FROM judged WHERE reason IS NULL""",
    "article_rejects": f"""
        WITH {_SHAPES}
        SELECT {_REQUESTED} AS request_url, doc_id AS position, {_STAGE} AS stage,
            reason AS reason_code, source
        FROM judged WHERE reason IS NOT NULL""",
    "article_json": f"""
        WITH {_SHAPES}
        SELECT doc_id AS position,
            'source|source_domain|requested_url|canonical_url|headline|published_at|description|'
            || 'author_names|modified_at|section|lead_image_url|language' AS keys,
            {_PUBLISHED} AS published_at, shape NOT IN (0, 1) AS null_image
        FROM judged WHERE reason IS NULL""",
    "fail_fast_prefix": f"""
        WITH {_SHAPES}
        SELECT doc_id AS position, site || 'a/' || doc_id AS canonical_url FROM judged
        WHERE doc_id < (SELECT min(doc_id) FROM judged WHERE reason IS NOT NULL)""",
    "article_sinks": f"""
        WITH {_SHAPES}
        SELECT source AS part, count(*) AS rows, 'processed' AS sink FROM judged
        WHERE reason IS NULL GROUP BY 1
        UNION ALL SELECT reason, count(*), 'failed' FROM judged WHERE reason IS NOT NULL GROUP BY 1
        UNION ALL SELECT 'all', count(*), 'raw' FROM judged""",
    "jsonld_limits": """
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id // 2 % 4 + 61 + 1 > 64 THEN 'jsonld_limits' END
            ELSE CASE WHEN 9994 + doc_id // 2 % 4 + 6 > 10000 THEN 'jsonld_limits' END END AS reason,
            (CASE WHEN reason IS NULL THEN 1 ELSE 0 END)::BIGINT AS candidates
        FROM documents""",
    "author_lists": f"""
        WITH words AS (
            SELECT doc_id, list_filter(string_split(
                trim(regexp_replace(text, '[\\x00-\\x20\\x7f]+', ' ', 'g'), ' '), ' '),
                lambda w: w <> '') AS given FROM documents),
        named AS (SELECT doc_id, given, list_filter(list_transform(given,
            lambda w: {_strip('w')}), lambda w: w <> '') AS names FROM words),
        spread AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM named),
        firsts AS (SELECT doc_id, name, min(i) AS i FROM spread GROUP BY 1, 2),
        kept AS (SELECT doc_id, count(*) AS kept, arg_min(name, i) AS first_name,
            arg_max(name, i) AS last_name FROM firsts GROUP BY 1)
        SELECT doc_id, len(given) AS given, coalesce(kept, 0) AS kept, first_name, last_name
        FROM named LEFT JOIN kept USING (doc_id)""",
    "timestamp_forms": """
        WITH cut AS (SELECT event_id, event_id % 8 AS kind, CASE event_id % 8
            WHEN 0 THEN ts WHEN 1 THEN date_trunc('milliseconds', ts) WHEN 2 THEN date_trunc('second', ts)
            WHEN 3 THEN date_trunc('hour', ts) WHEN 7 THEN date_trunc('minute', ts) END AS t FROM events)
        SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S')
            || CASE WHEN t = date_trunc('second', t) THEN '' ELSE '.' || strftime(t, '%f') END
            || '+00:00' AS instant
        FROM cut""",
    "crawl_outcomes": f"""
        WITH {_SHAPES}, flow AS (
            SELECT *, CASE WHEN reason = 'robots_disallowed' THEN reason
                WHEN doc_id % 9 = 0 OR doc_id % 10 = 7 THEN 'request_error' ELSE reason END AS final
            FROM judged)
        SELECT CASE WHEN final IS NULL THEN 'accepted' WHEN final = 'request_error' THEN 'transport'
            ELSE {_STAGE.replace('CASE reason', 'CASE final')} END AS stage,
            coalesce(final, 'accepted') AS reason_code, count(*) AS requests
        FROM flow GROUP BY 1, 2""",
    "document_items": """
        WITH kinds AS (SELECT page_id, length(url) % 6 AS kind, length(html) AS chars,
            (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs FROM pages)
        SELECT page_id, 0 AS item_pos, 'page' AS label, chars AS size, NULL AS reason_code
        FROM kinds WHERE kind > 0
        UNION ALL SELECT page_id, 1, 'paragraphs', paragraphs, NULL FROM kinds WHERE kind > 0
        UNION ALL SELECT page_id, 2, NULL, NULL, CASE kind WHEN 1 THEN 'article_invalid'
            WHEN 4 THEN 'parser_execution' ELSE 'parser_contract' END
        FROM kinds WHERE kind BETWEEN 1 AND 4""",
    "item_prefix": """
        WITH kinds AS (SELECT page_id, length(url) % 6 AS kind FROM pages),
        stop AS (SELECT min(page_id) AS page_id FROM kinds WHERE kind BETWEEN 1 AND 4)
        SELECT k.page_id, p.item_pos, p.label
        FROM kinds k, (VALUES (0, 'page'), (1, 'paragraphs')) p(item_pos, label)
        WHERE kind > 0 AND k.page_id <= coalesce((SELECT page_id FROM stop), k.page_id)""",
    "redact_documents": f"""
        SELECT doc_id, regexp_replace(text,
            '(^|[^\\pL\\pN_-])((?:{_KEYS})\\s*[:=]\\s*)(?:"[^"\\n]*"|''[^''\\n]*''|(?:Bearer|Basic)\\s+[^\\s,;}}\\]]+|[^\\s,;}}\\]]+)',
            '\\1\\2[REDACTED]', 'gi') AS text
        FROM documents""",
    "redact_maps": """
        SELECT event_id, CASE WHEN event_id % 5 IN (0, 2, 4) THEN '[REDACTED]' ELSE props END AS planted,
            event_type AS event
        FROM events""",
    "log_lines": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000 | '
            || CASE event_id % 5 WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END
            || ' | app.' || event_type || ' | '
            || CASE WHEN event_id % 3 > 0 THEN user_id::VARCHAR ELSE '-' END
            || ' | props=' || props || ' token: [REDACTED]' AS line
        FROM events WHERE event_id % 5 >= 2""",
    "stream_articles": f"""
        WITH {_SHAPES}
        SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS rows,
            min(CASE WHEN reason IS NULL THEN site || 'a/' || doc_id END) AS first_url,
            sum(CASE WHEN reason IS NULL THEN length({_DESCRIPTION}) END)::BIGINT AS description_chars
        FROM judged GROUP BY 1""",
    "stream_first_captures": f"""
        WITH {_SHAPES}
        SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS rows,
            min(CASE WHEN reason IS NULL THEN site || 'a/' || doc_id END) AS first_url
        FROM judged GROUP BY 1""",
    "stream_attempts": f"WITH {_ATTEMPTS}, {_ENDINGS}",
    "stream_identities": f"""
        WITH seen AS (
            SELECT page_id * 61 // 86400 AS day, {_ORIGIN} AS origin, 'page' AS side,
                CASE WHEN page_id % 40 = 0 THEN 'Other/2' ELSE 'Agent/1' END AS agent FROM pages
            UNION ALL
            SELECT (page_id * 61 + 7) // 86400, {_ORIGIN}, 'robots',
                CASE WHEN length({_ORIGIN}) % 9 = 0 THEN 'Other/2' ELSE 'Agent/1' END
            FROM pages WHERE length({_ORIGIN}) % 4 > 0)
        SELECT day, origin, count(DISTINCT agent) FILTER (side = 'page') AS page_agents,
            count(DISTINCT agent) FILTER (side = 'robots') AS robots_agents,
            count(DISTINCT agent) AS agents
        FROM seen GROUP BY 1, 2
        HAVING page_agents > 0 AND robots_agents > 0 AND agents > 1""",
    "stream_robots": f"""
        SELECT DISTINCT {_ORIGIN} AS origin, 'rules' AS policy, 2 AS rules FROM pages""",
    "robots_versions": f"""
        SELECT DISTINCT {_ORIGIN} AS origin,
            CASE WHEN length({_ORIGIN}) % 2 = 0 THEN 'robots_status_unsupported' ELSE 'rules' END AS first_policy,
            CASE WHEN length({_ORIGIN}) % 2 = 0 THEN 0 ELSE 2 END AS first_rules, 'rules' AS latest_policy,
            CASE WHEN length({_ORIGIN}) % 2 = 0 THEN 1 ELSE 2 END AS latest_rules, 1 AS rows
        FROM pages""",
    "robots_refresh": f"""
        SELECT page_id, {_RULE_OF_PAGE} AS before,
            CASE WHEN {_PATH} LIKE '/de/%' THEN 'robots_disallowed' END AS after
        FROM pages""",
}
