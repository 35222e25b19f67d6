"""Fixed table schemas, as DDL strings that every reader and builder accepts."""

from __future__ import annotations

REQUESTS = (
    "position bigint, url string, method string, headers map<string,string>, "
    "query_params map<string,string>, body binary, metadata map<string,string>"
)
RESPONSES = (
    "request_url string, final_url string, status_code int, headers map<string,string>, "
    "body binary, elapsed double, metadata map<string,string>, fetched_at timestamp"
)
PROFILES = (
    "source string, domains array<string>, parser_family string, adapter_key string, "
    "enabled boolean, position int"
)
ROBOTS = "origin string, status_code int, body binary, fetched_at timestamp"
ATTEMPTS = (
    "request_id bigint, attempt_no int, method string, status_code int, error_class string"
)
LOGS = (
    "ts timestamp, level string, logger string, correlation_id string, message string"
)
ARTICLES = (
    "source string, source_domain string, requested_url string, canonical_url string, "
    "headline string, published_at timestamp, description string, "
    "author_names array<string>, modified_at timestamp, section string, "
    "lead_image_url string, language string"
)
FAILED = "request_url string, position bigint, stage string, reason_code string, source string"

ARTICLE_COLUMNS = tuple(field.split()[0] for field in ARTICLES.split(", "))
PROFILE_COLUMNS = ("source", "domains", "parser_family", "adapter_key", "enabled")

# Every reason code with the stage that gives it. Stages are in the order
# in which they are decided; the first failure of a row wins.
STAGE_OF_REASON = {
    "request_url_blank": "request",
    "target_url_malformed": "fetch",
    "target_url_incomplete": "fetch",
    "robots_status_unsupported": "robots",
    "robots_unavailable": "robots",
    "robots_unparseable": "robots",
    "robots_disallowed": "robots",
    "request_error": "transport",
    "response_retry_exhausted": "transport",
    "response_error": "transport",
    "response_status": "status",
    "content_type_missing": "media_type",
    "content_type_unsupported": "media_type",
    "decoding_failed": "decode",
    "document_invalid": "document",
    "source_unresolved": "resolve",
    "source_disabled": "resolve",
    "source_adapter_unsupported": "resolve",
    "source_family_unsupported": "resolve",
    "source_parser_refused": "resolve",
    "jsonld_limits": "parse",
    "no_candidate": "parse",
    "canonical_invalid": "canonical",
    "canonical_out_of_bounds": "canonical",
    "candidate_ambiguous": "select",
    "candidate_no_match": "select",
    "headline_missing": "fields",
    "published_missing": "fields",
    "article_invalid": "contract",
    "parser_contract": "parser",
    "parser_execution": "parser",
}
