"""Shared constants: label order, cut points, limits."""

LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
RARE_LABELS = ["severe_toxic", "threat", "obscene", "identity_hate"]

SEVERITIES = ["SAFE", "LOW", "MEDIUM", "HIGH"]
CUT_LOW = 0.30
CUT_MEDIUM = 0.55
CUT_HIGH = 0.75

GATE_LOW = 0.40
GATE_HIGH = 0.60
GATE_FACTOR = 0.8

DELIVERED, FLAGGED, BLOCKED = "DELIVERED", "FLAGGED", "BLOCKED"

HISTORY_KEEP = 5
CONTEXT_TURNS = 4

RATE_LIMIT = 20
RATE_WINDOW_S = 60
RATE_IDLE_S = 120
DUPLICATE_GAP_MS = 5000

RETRAIN_THRESHOLD = 500
DEFAULT_TAG_THRESHOLD = 0.50
NO_POSITIVE_THRESHOLD = 0.15

TEXT_MAX = 5000
BATCH_MAX = 50
NOTES_MAX = 1000

BYPASS_VERSION = "bypass"
OFFLINE_VERSION = "fallback-offline"
LEXICON_VERSION = "lexicon-1"
