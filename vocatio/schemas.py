"""Schemas, keys and checks of the tables.  Checks are SQL conditions; a row passes if none is false."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Table:
    """``references``: column to (table, column) it must exist in."""

    schema: str
    keys: tuple[str, ...]
    checks: dict[str, str] = field(default_factory=dict)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


TABLES = {
    "cip_codes": Table(
        "cip_code string, cip_title string, cip_definition string, level int, parent_cip_code string, "
        "is_active boolean, crosswalk_notes string",
        ("cip_code",),
        {
            "level": "level IN (2, 4, 6)",
            "format": r"(level = 2 AND cip_code RLIKE '^[0-9]{2}$') OR (level = 4 AND cip_code RLIKE '^[0-9]{2}[.][0-9]{2}$') "
            r"OR (level = 6 AND cip_code RLIKE '^[0-9]{2}[.][0-9]{4}$')",
            "title": "cip_title <> ''",
        },
        {"parent_cip_code": ("cip_codes", "cip_code")},
    ),
    "occupations": Table(
        "onet_soc_code string, title string, description string, soc_2018_code string, job_zone int",
        ("onet_soc_code",),
        {"title": "title <> ''"},
    ),
    "alt_titles": Table(
        "onet_soc_code string, alt_title string, short_title string, source string",
        ("onet_soc_code", "alt_title"),
        {"alt_title": "alt_title <> ''"},
        {"onet_soc_code": ("occupations", "onet_soc_code")},
    ),
    "crosswalk": Table(
        "cip_code string, onet_soc_code string, crosswalk_source string",
        ("cip_code", "onet_soc_code", "crosswalk_source"),
        {},
        {"cip_code": ("cip_codes", "cip_code"), "onet_soc_code": ("occupations", "onet_soc_code")},
    ),
    "sources": Table(
        "source_type string, name string, base_url string, auth_mode string, enabled boolean, "
        "politeness map<string,double>, terms_reviewed_at string",
        ("name",),
        {"source_type": "source_type IN ('ats_api', 'feed', 'career_page')", "name": "name <> ''"},
    ),
    "companies": Table(
        "company_id string, canonical_name string, normalized_name string, domain string, "
        "first_seen_at timestamp, last_seen_at timestamp",
        ("company_id",),
    ),
    "raw_documents": Table(
        "source_id string, url string, doc_type string, sha256 string, n_bytes long, fetched_at timestamp",
        ("source_id", "url", "doc_type", "sha256"),
        {"doc_type": "doc_type IN ('api_response', 'posting_description')"},
    ),
    "postings": Table(
        "source_id string, source_posting_id string, company_id string, title string, description_sha256 string, "
        "employment_type string, is_remote boolean, location_raw string, city string, state string, country string, "
        "scope_reason string, posted_at timestamp, content_hash string, status string, first_seen_at timestamp, "
        "last_seen_at timestamp, closed_at timestamp",
        ("source_id", "source_posting_id"),
        {"status": "status IN ('active', 'stale', 'closed')"},
    ),
    "posting_versions": Table(
        "source_id string, source_posting_id string, title string, description_sha256 string, content_hash string, "
        "recorded_at timestamp, change_no int",
        ("source_id", "source_posting_id", "recorded_at", "change_no"),
    ),
    "payloads": Table("prefix string, key string, sha256 string, n_bytes long, payload string", ("sha256",)),
    "rejected": Table("source_id string, url string, fate string, rejected string, reason string, at timestamp", ("source_id", "url", "at")),
    "counters": Table(
        "source_id string, seen long, new long, updated long, unchanged long, excluded_non_us long, parse_failed long, "
        "quarantined long, at timestamp",
        ("source_id", "at"),
    ),
}
