"""Vocabularies and lookup tables. All values here are fixed: results must use exactly these words."""

SEVERITIES = ("critical", "high", "medium", "low")
HELD_REASONS = (
    "redaction_failed", "residual_pii_detected", "classifier_uncertain", "malformed_model_output", "schema_invalid",
    "emergency_review", "missing_transcript", "cost_cap_held", "weak_servicetitan_match", "classified_spam",
)
DROP_REASONS = (
    "zero_duration", "non_conversation_call_state", "outbound_no_customer_conversation", "internal_transfer_non_operator_leg",
    "classified_non_customer", "duplicate_call_leg", "below_minimum_duration",
)
REVIEW_STATUSES = ("open", "in_review", "resolved", "unresolvable")
CALL_STATUSES = ("processing", "completed", "skipped", "held", "review_closed")
PROTECTED_STATUSES = ("completed", "skipped", "held", "review_closed")
CALL_INTENTS = ("new_booking", "existing_job", "quote", "emergency", "billing", "general")
#: Most severe first.
URGENCIES = ("emergency", "urgent", "routine")
SERVICE_CATEGORIES = (
    "water_heater", "drain_blockage", "leak_detection_or_repair", "sewer_or_septic", "toilet", "faucet_sink_or_fixture",
    "shower_or_tub", "gas_line", "sump_pump_or_drainage", "water_quality_or_treatment", "repipe_or_pipe_repair",
    "appliance_install_or_hookup", "inspection_or_maintenance", "grinder_pump", "other",
)
SENTIMENTS = ("positive", "neutral", "negative", "frustrated")
VERDICTS = ("correct", "wrong", "missing", "should_not_be_here")
NON_DISPATCH_INTENTS = ("general", "billing")
STAGES = (
    "metadata-pre-filter", "fetch-transcript", "transcript-availability", "redact", "classify", "extract",
    "verbatim-pii-scan", "store", "mark-retention-eligible",
)
SKIP_STAGES = ("metadata-pre-filter", "fetch-transcript", "classify")
ENTITY_TYPES = (
    "name", "location", "organization", "phone", "email", "street_address", "cross_street", "credit_card",
    "government_id", "number", "deny_list", "other",
)
#: Where a scope for a failure's dedup key is looked for, first one wins.
DEDUP_SCOPES = ("call_id", "job_id", "component", "stage", "environment")

#: Held reason -> stages a review may send the call back to.
REPROCESS_STAGES = {
    "classifier_uncertain": ("classify", "extract"), "classified_spam": ("classify",), "malformed_model_output": ("classify",),
    "schema_invalid": ("extract",), "redaction_failed": ("redact",), "residual_pii_detected": ("redact",),
    "missing_transcript": ("fetch-transcript", "transcript-availability"), "cost_cap_held": ("classify", "extract"),
    "weak_servicetitan_match": (), "emergency_review": ("verbatim-pii-scan",),
}
#: Held reason -> stage to which an approval moves the call on.
APPROVE_STAGE = {"classifier_uncertain": "extract", "emergency_review": "verbatim-pii-scan"}


def allowed_actions(reason: str) -> tuple[str, ...]:
    """Review actions that a held reason permits."""
    return tuple(
        action
        for action, ok in (
            ("approve", reason in APPROVE_STAGE),
            ("reject", True),
            ("mark_non_customer", reason != "weak_servicetitan_match"),
            ("mark_spam", reason not in ("missing_transcript", "weak_servicetitan_match")),
            ("correct_extraction", reason == "schema_invalid"),
            ("reprocess", bool(REPROCESS_STAGES[reason])),
            ("mark_unresolvable", True),
        )
        if ok
    )


#: Risk reason -> (weight, forces a hold, output is safe once redacted).
RISK = {
    "ner_low_confidence": (0.15, False, False), "detector_disagreement": (0.1, False, True), "deny_list_hit": (0.1, False, True),
    "high_entity_density": (0.1, False, True), "ner_offset_alignment_failed": (1.0, True, False),
    "transcript_chunking_truncated": (0.3, False, False), "address_like_ambiguous": (0.2, False, False),
    "short_transcript": (0.1, False, False), "residual_scan_hit": (1.0, True, False),
}

EMERGENCY_PHRASES = (
    "gas leak", "smell gas", "smell of gas", "gas smell", "carbon monoxide", "sewage backup", "sewage backing up", "raw sewage",
    "sewage in", "burst pipe", "pipe burst", "pipe has burst", "flooding", "flooded", "water everywhere", "water pouring", "water gushing",
)
AMBIGUOUS_PHRASES = (
    "active leak", "leaking right now", "cannot shut off", "can't shut off", "won't shut off", "water won't stop",
    "no water at all", "no usable toilet", "only toilet",
)

RESIDUAL_CATEGORIES = (
    "vault_value_reintroduced", "digit_run", "spelled_out_digits", "email_like", "address_like", "name_like_after_greeting", "deny_list_term",
)


#: Every failure code with its usual severity; the root-cause category of a code has the code's own name.
FAILURES = {
    "CONFIG_MISSING_OR_INVALID": "high",
    "DATABASE_UNAVAILABLE": "critical",
    "REDIS_UNAVAILABLE": "critical",
    "MIGRATION_FAILED": "high",
    "DIALPAD_AUTH_FAILED": "high",
    "DIALPAD_RATE_LIMITED": "medium",
    "DIALPAD_API_CHANGED": "high",
    "DIALPAD_TRANSCRIPT_MISSING": "low",
    "WEBHOOK_SIGNATURE_INVALID": "medium",
    "WEBHOOK_REPLAY_DETECTED": "low",
    "REDACTION_RECALL_REGRESSION": "critical",
    "REDACTION_LOW_CONFIDENCE": "medium",
    "MODEL_AUTH_FAILED": "high",
    "MODEL_RATE_LIMITED": "medium",
    "MODEL_MALFORMED_RESPONSE": "medium",
    "MODEL_COST_CAP_EXCEEDED": "high",
    "MODEL_COST_WARNING_THRESHOLD_EXCEEDED": "medium",
    "QUEUE_RETRY_EXHAUSTED": "high",
    "DEAD_LETTER_CREATED": "high",
    "RETENTION_PURGE_FAILED": "high",
    "BACKFILL_CHECKPOINT_FAILED": "medium",
    "REVIEW_QUEUE_STALLED": "medium",
    "SERVICETITAN_AUTH_FAILED": "high",
    "SERVICETITAN_MATCH_WEAK": "low",
    "SERVICETITAN_WRITE_FAILED": "medium",
    "REQUEST_BODY_TOO_LARGE": "low",
    "REQUEST_MALFORMED": "low",
    "UNSUPPORTED_MEDIA_TYPE": "low",
    "RATE_LIMIT_EXCEEDED": "low",
    "AUTH_REQUIRED": "low",
    "AUTH_FORBIDDEN": "low",
    "CSRF_TOKEN_INVALID": "low",
    "WEBHOOK_TIMESTAMP_INVALID": "low",
    "INTERNAL_ERROR": "high",
    "VERBATIM_PII_DETECTED": "high",
    "KEY_ROTATION_FAILED": "critical",
    "KEY_REVOCATION_FAILED": "critical",
    "TECHNICIAN_NOTE_RUN_DEGRADED": "medium",
}
