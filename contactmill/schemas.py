"""Schemas of the eight pipeline tables and of the recorded inputs."""

from __future__ import annotations

from pyspark.sql import types as T

from contactmill.functions import fixed_values as fv

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LEADS = _schema(
    ("id", _S), ("business_name", _S), ("business_type", _S), ("website", _S), ("phone", _S),
    ("address", _S), ("city", _S), ("state_province", _S), ("country", _S), ("source", _S),
    ("source_id", _S), ("google_rating", _D), ("google_review_count", _I), ("score", _I),
    ("pipeline_stage", _S), ("created_at", _TS), ("updated_at", _TS),
)
LEAD_EMAILS = _schema(
    ("id", _S), ("lead_id", _S), ("email", _S), ("contact_name", _S), ("role", _S),
    ("verification_status", _S), ("source", _S), ("is_primary", _B), ("created_at", _TS),
)
LEAD_ENRICHMENT = _schema(
    ("id", _S), ("lead_id", _S), ("has_multiple_tutors", _B), ("existing_scheduling_tool", _S),
    ("linkedin_url", _S), ("facebook_url", _S), ("founded_year", _I), ("team_size_estimate", _S),
    ("specialties", T.ArrayType(_S)), ("raw_data", _S), ("enriched_at", _TS),
    ("enrichment_attempts", _I), ("last_enrichment_attempt_at", _TS), ("emails_found_count", _I),
)
SEQUENCES = _schema(
    ("id", _S), ("name", _S), ("total_steps", _I), ("status", _S), ("created_at", _TS),
    ("updated_at", _TS),
)
SEQUENCE_STEPS = _schema(
    ("id", _S), ("sequence_id", _S), ("step_number", _I), ("delay_hours", _I),
    ("subject_template", _S), ("body_template", _S), ("created_at", _TS),
)
SEQUENCE_ENROLLMENTS = _schema(
    ("id", _S), ("lead_id", _S), ("sequence_id", _S), ("email_id", _S), ("current_step", _I),
    ("status", _S), ("next_send_at", _TS), ("enrolled_at", _TS), ("completed_at", _TS),
)
SEND_LOG = _schema(
    ("id", _S), ("lead_id", _S), ("email_id", _S), ("sequence_id", _S), ("step_number", _I),
    ("ses_message_id", _S), ("status", _S), ("sent_at", _TS),
)
DISCOVERY_RUNS = _schema(
    ("id", _S), ("source", _S), ("query", _S), ("location", _S), ("leads_found", _L),
    ("leads_new", _L), ("leads_duplicate", _L), ("status", _S), ("started_at", _TS),
    ("completed_at", _TS), ("error_message", _S),
)

TABLES = {
    "leads": LEADS,
    "lead_emails": LEAD_EMAILS,
    "lead_enrichment": LEAD_ENRICHMENT,
    "sequences": SEQUENCES,
    "sequence_steps": SEQUENCE_STEPS,
    "sequence_enrollments": SEQUENCE_ENROLLMENTS,
    "send_log": SEND_LOG,
    "discovery_runs": DISCOVERY_RUNS,
}

# The column each table is joined on most; used when a snapshot is written bucketed.
BUCKET_KEYS = {
    "leads": "id",
    "lead_emails": "lead_id",
    "lead_enrichment": "lead_id",
    "sequence_enrollments": "lead_id",
    "send_log": "lead_id",
}

# Values a row may carry; null passes, as in a CHECK constraint.
ENUMS = {
    "leads": {
        "business_type": fv.BUSINESS_TYPES, "country": fv.COUNTRIES, "source": fv.LEAD_SOURCES,
    },
    "lead_emails": {
        "role": fv.EMAIL_ROLES, "verification_status": fv.VERIFICATION_STATUSES,
        "source": fv.EMAIL_SOURCES,
    },
    "sequences": {"status": fv.SEQUENCE_STATUSES},
    "sequence_enrollments": {"status": fv.ENROLMENT_STATUSES},
    "send_log": {"status": fv.SEND_STATUSES},
}
REQUIRED = {
    "leads": ["id", "business_name", "created_at", "updated_at"],
    "lead_emails": ["id", "lead_id", "email", "created_at"],
    "lead_enrichment": ["id", "lead_id", "enriched_at"],
    "sequences": ["id", "name", "total_steps", "created_at", "updated_at"],
    "sequence_steps": [
        "id", "sequence_id", "step_number", "delay_hours", "subject_template", "body_template",
        "created_at",
    ],
    "sequence_enrollments": ["id", "lead_id", "sequence_id", "email_id", "enrolled_at"],
    "send_log": ["id", "lead_id", "email_id", "sent_at"],
    "discovery_runs": ["id", "source", "query", "started_at"],
}
DEFAULTS = {
    "leads": {"score": 0, "pipeline_stage": "new"},
    "lead_emails": {"verification_status": "unverified", "is_primary": False},
    "lead_enrichment": {"enrichment_attempts": 0, "emails_found_count": 0},
    "sequences": {"status": "active"},
    "sequence_steps": {"delay_hours": 0},
    "sequence_enrollments": {"current_step": 0, "status": "active"},
    "send_log": {"status": "sent"},
    "discovery_runs": {"leads_found": 0, "leads_new": 0, "leads_duplicate": 0},
}

ADDRESS_COMPONENTS = T.ArrayType(
    _schema(("long_name", _S), ("short_name", _S), ("types", T.ArrayType(_S)))
)
PLACE_SEARCH_FILE = _schema(
    ("status", _S),
    ("next_page_token", _S),
    (
        "results",
        T.ArrayType(
            _schema(
                ("place_id", _S), ("name", _S), ("formatted_address", _S), ("vicinity", _S),
                ("types", T.ArrayType(_S)), ("rating", _D), ("user_ratings_total", _I),
                ("business_status", _S),
            )
        ),
    ),
)
PLACE_DETAILS_FILE = _schema(
    ("status", _S),
    (
        "result",
        _schema(
            ("place_id", _S), ("name", _S), ("formatted_address", _S),
            ("formatted_phone_number", _S), ("website", _S), ("rating", _D),
            ("user_ratings_total", _I), ("types", T.ArrayType(_S)), ("business_status", _S),
            ("address_components", ADDRESS_COMPONENTS),
        ),
    ),
)
SEQUENCE_FILE = _schema(
    ("name", _S),
    (
        "steps",
        T.ArrayType(
            _schema(
                ("step_number", _I), ("delay_hours", _I), ("subject_template", _S),
                ("body_template", _S),
            )
        ),
    ),
)
