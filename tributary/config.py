"""Constants of the merge analysis.

These are fixed values: results depend on them.
"""

# Alignment and similarity
SKIP_PENALTY = -0.05
WEIGHTS = {"visual": 0.45, "transcript": 0.40, "duration": 0.10, "order": 0.05}
VISUAL_WEIGHTS = {"structure": 0.40, "rgb": 0.30, "histogram": 0.30}
ORDER_MAX_GAP = 4
ZERO_HASH = "0" * 16

# Edit classification
UNCHANGED_MIN = 0.85
UNCHANGED_MAX_REL_DIFF = 0.10
REPLACE_MIN = 0.50
TRIM_MIN_VISUAL = 0.85
TRIM_MAX_REL_DIFF = 0.30

# Segmentation
SCENE_THRESHOLD = 27.0

# Transcript gate
GATE_THRESHOLD = 0.75
GATE_SOFT_FLOOR = 0.50
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
MARKERS = {
    "negation": ["not", "no", "never", "neither", "nor", "without", "n't"],
    "prerequisite": ["before", "until", "once", "first", "preheat"],
    "qualifier": ["severe", "must", "only", "always", "allergy", "allergies"],
    "exception": ["unless", "except", "otherwise"],
    "entity": ["all customers", "all patients", "customers with", "patients with", "premium"],
    "temporal": ["for 7 days", "for ten minutes", "for 10 minutes", "twice daily", "after", "within", "during", "while"],
    "causal": ["because", "so that", "in order to", "causes", "results in"],
}

# Severities
INTERACTION_SEVERITY = {"none": 0, "amplifies_existing_issue": 1, "creates_new_conflict": 2}
IMPORTANCE = {"low": 0, "medium": 1, "high": 2, "critical": 3}
STATUS_SEVERITY = {"preserved": 0, "degraded": 1, "broken": 2}

# Records of claims, verdicts and analyses
CLAIM_TYPES = [
    "prerequisite", "qualifier", "exception", "temporal_scope", "causal_dependency", "entity_scope", "instruction", "prohibition", "narrative_dependency", "other",
]
CONFLICT_TYPES = [
    "prerequisite_loss", "qualifier_loss", "exception_loss", "temporal_scope_change", "causal_dependency_break", "entity_scope_change", "narrative_dependency_break",
    "contradiction", "other",
]
SURROGATE_RATIONALE = "(no M3 verdict; deterministic surrogate)"
SUMMARIES = {
    "creates_new_conflict": "The branches are individually non-breaking, but together remove or break a BASE claim.",
    "amplifies_existing_issue": "The combined edits make an existing semantic issue materially worse.",
    "none": "No new semantic conflict was detected between these edits.",
}

# Failure classification: message tokens in order of precedence, then exception classes
FAILURE_TOKENS = {
    "provider": [
        "GMI Cloud 429", "GMI Cloud 502", "GMI Cloud 503", "GMI Cloud 504", "HTTP error talking to GMI Cloud", "upstream_503", "rate_limit_exceeded",
        "temporarily unavailable", "connection reset", "overload",
    ],
    "schema": [
        "ValidationError", "validation error", "missing 'claims'", "missing 'explanation'", "non-JSON", "M3 failed to return a valid claim list",
        "M3 failed to return a valid ClaimEvaluation", "extras_forbidden",
    ],
    "semantic": ["no rule matched", "explanation did not influence"],
}
FAILURE_CLASSES = {
    "schema": ["ValidationError", "PydanticValidationError", "JSONDecodeError"],
    "orchestrator": ["KeyError", "TypeError", "ValueError", "AssertionError", "RuntimeError"],
}
FAILED_ATTEMPT_CAP = 12
RUNS_PER_FIXTURE = 4

# Retries of upstream calls
RETRY_STATUSES = [429, 502, 503, 504]
RETRY_BODY_TOKENS = [
    "upstream_503", "upstream 503", "overload", "overloaded", "temporarily unavailable", "temporary unavailable", "rate_limit_exceeded",
    "rate limit exceeded", "rate-limit exceeded", "connection reset", "connection_reset",
]
AUTH_BODY_TOKENS = ["invalid api key", "invalid_api_key", "authentication invalid", "unauthorized", "401"]
TRANSPORT_ERRORS = ["TimeoutException", "ConnectError", "RemoteProtocolError", "TransportError"]
RETRY_DELAYS = [2.0, 5.0, 10.0, 20.0]
RETRY_JITTER = 0.25
