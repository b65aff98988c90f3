"""Schemas of the tables that the engine works on, as Spark types.

A table of one's own in these shapes can be handed to every operator; the registered queries use views of the same
columns over the test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "candidate_profile": """
        id string, name string, headline string, seniority string, total_years double, summary string, locations array<string>,
        target_titles array<string>, relocation boolean, remote_pref string, salary_min decimal(12,2), salary_currency string,
        languages array<struct<code:string,level:string>>, education array<struct<institution:string,degree:string,field:string,end_year:int>>,
        raw_text string, embedding array<float>, headline_embedding array<float>, is_active boolean, parse_status string,
        parse_error string, parse_started_at timestamp, ats_report string, resume_filename string, resume_size long,
        resume_format string, created_at timestamp""",
    "profile_contact": """
        id string, profile_id string, full_name string, phone string, email string, city string, full_name_edited boolean,
        phone_edited boolean, email_edited boolean, city_edited boolean""",
    "profile_contact_link": "contact_id string, kind string, url string, label string, is_manual boolean, position int",
    "profile_skill": """
        profile_id string, canonical_name string, raw_names array<string>, years double, level string, evidence string,
        last_used_year int""",
    "profile_experience": """
        profile_id string, position int, company string, title string, start string, end string, is_current boolean,
        stack array<string>, domains array<string>""",
    "vacancy": """
        id string, fingerprint string, title string, company string, company_url string, description_raw string, description_md string,
        seniority string, min_years double, city string, country string, remote string, salary_min decimal(12,2), salary_max decimal(12,2),
        currency string, is_gross boolean, period string, salary_min_normalized decimal(12,2), salary_max_normalized decimal(12,2),
        salary_normalized_at timestamp, employment_type string, language string, published_at timestamp, expires_at timestamp,
        first_seen_at timestamp, last_seen_at timestamp, is_active boolean, fingerprint_version int, completeness double,
        work_authorization string, is_spam boolean, spam_signals array<string>, enriched_at timestamp, embedding array<float>,
        embedding_hash string, embedded_at timestamp, title_embedding array<float>, title_embedding_hash string""",
    "vacancy_source": "id string, vacancy_id string, source_slug string, external_id string, url string, raw string",
    "vacancy_skill": "vacancy_id string, canonical_name string, is_required boolean, weight decimal(3,2), source string",
    "match": """
        profile_id string, vacancy_id string, score decimal(5,2), rule_score decimal(5,2), semantic_score decimal(5,2), llm_score decimal(5,2),
        bucket string, component_scores map<string,decimal(5,2)>, matched_skills array<struct<canonical_name:string,coverage:double>>,
        missing_required array<struct<canonical_name:string,weight:double>>, missing_nice array<string>, red_flags array<string>,
        experience_gap_years double, verdict string, application_angle string, scored_at timestamp""",
    "application": """
        id string, vacancy_id string, profile_id string, created_at timestamp, status string, applied_at timestamp, notes string, cover_letter string,
        letter_rules_version string, sent_at timestamp, sent_letter string, agent_status string, agent_reason string,
        match_score decimal(5,2), match_bucket string, match_explanation string, vacancy_key_skills array<string>, hh_warning string,
        hh_blocking_warning string, hh_negotiations_total int, hh_last_state string, hh_last_state_at timestamp, confirmed_at timestamp,
        confirmed_letter_digest string, confirmed_card_digest string""",
    "generated_document": """
        profile_id string, vacancy_id string, kind string, version int, payload string, text string, file_format string,
        ats_report string, rules_version string, source string, problems array<string>""",
    "pipeline_run": """
        id string, source_slug string, status string, started_at timestamp, finished_at timestamp, found int, new int, updated int,
        errors array<string>""",
    "source_quota": "source_slug string, day date, used int",
    "source_state": "source_slug string, key string, value string",
    "reference_document": "id string, kind string, title string, note string, text string, is_active boolean, provenance string",
    "generation_rule": "id string, kind string, scope string, severity string, params map<string,string>, message string, is_active boolean",
    "journal": """
        vacancy_id string, status string, title string, company string, url string, letter_digest string, reason string,
        first_seen_at timestamp, updated_at timestamp""",
}

TABLES = tuple(_DDL)

#: Which column of which table refers to which key, and what becomes of a row whose reference goes.
REFERENCES = [
    ("profile_contact", "profile_id", "candidate_profile", "id", "cascade"), ("profile_contact_link", "contact_id", "profile_contact", "id", "cascade"),
    ("profile_skill", "profile_id", "candidate_profile", "id", "cascade"), ("profile_experience", "profile_id", "candidate_profile", "id", "cascade"),
    ("vacancy_source", "vacancy_id", "vacancy", "id", "cascade"), ("vacancy_skill", "vacancy_id", "vacancy", "id", "cascade"),
    ("match", "profile_id", "candidate_profile", "id", "cascade"), ("match", "vacancy_id", "vacancy", "id", "cascade"),
    ("application", "vacancy_id", "vacancy", "id", "cascade"), ("application", "profile_id", "candidate_profile", "id", "set null"),
    ("generated_document", "profile_id", "candidate_profile", "id", "cascade"), ("generated_document", "vacancy_id", "vacancy", "id", "cascade"),
]


def schema(name: str) -> StructType:
    """The Spark type of a table's rows."""
    return StructType.fromDDL(_DDL[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the table's columns, order and types; columns that df lacks are null, further ones go."""
    held = {c.lower() for c in df.columns}
    pick = lambda f: F.col(f.name).cast(f.dataType) if f.name.lower() in held else F.lit(None).cast(f.dataType)
    return df.select(*[pick(f).alias(f.name) for f in schema(name).fields])
