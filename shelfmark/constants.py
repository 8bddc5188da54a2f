"""They must equal the published behaviour for right results."""

DEFAULT_SOURCE = "hf"
CONNECTOR_SOURCE = "hf_connector"

ARTIFACT_KINDS = ("schema", "stats", "snips")
REQUIRED_ENTRY_FIELDS = ("id", "source", "ns_local_id")

TASK_MODALITIES = {
    "text-classification": ["text"],
    "text-generation": ["text"],
    "question-answering": ["text"],
    "summarization": ["text"],
    "translation": ["text"],
    "text2text-generation": ["text"],
    "fill-mask": ["text"],
    "token-classification": ["text"],
    "sentence-similarity": ["text"],
    "feature-extraction": ["text"],
    "image-classification": ["image"],
    "object-detection": ["image"],
    "image-segmentation": ["image"],
    "depth-estimation": ["image"],
    "image-to-image": ["image"],
    "unconditional-image-generation": ["image"],
    "zero-shot-image-classification": ["image"],
    "image-captioning": ["image", "text"],
    "image-to-text": ["image", "text"],
    "visual-question-answering": ["image", "text"],
    "document-question-answering": ["image", "text"],
    "image-text-to-text": ["image", "text"],
    "automatic-speech-recognition": ["audio"],
    "audio-classification": ["audio"],
    "audio-to-audio": ["audio"],
    "text-to-audio": ["audio", "text"],
    "text-to-speech": ["audio", "text"],
    "tabular-classification": ["tabular"],
    "tabular-regression": ["tabular"],
    "tabular-to-text": ["tabular", "text"],
    "video-classification": ["video"],
}

# Smallest first; the position is the rank.
SIZE_CLASSES = [
    "n<1K",
    "1K<n<10K",
    "10K<n<100K",
    "100K<n<1M",
    "1M<n<10M",
    "10M<n<100M",
    "n>100M",
]

LICENSE_ALLOWLIST = [
    "apache-2.0",
    "mit",
    "bsd-3-clause",
    "bsd-2-clause",
    "cc-by-4.0",
    "cc-by-sa-4.0",
    "cc0-1.0",
    "openrail",
    "cdla-permissive-2.0",
    "odc-by",
    "odc-odbl",
]

# (id, label, query, target_id, total_relevant)
SEED_EVAL_QUERIES = [
    ("Q1", "direct entity match", "teleportation health survey",
     "NeuralNebula/teleportation-health-survey", 1),
    ("Q2", "structural, fiction removed", "symptom survey frequency",
     "NeuralNebula/teleportation-health-survey", 1),
    ("Q3", "column level", "nausea dizziness questionnaire respondents",
     "NeuralNebula/teleportation-health-survey", 1),
]

RESOLVE_BUDGET_MS = 1500
RESOLVE_ROW_CAP = 200
RESOLVE_P95_MAX_MS = 3000
QUEUE_DEPTH_MAX = 500
LEASE_TIMEOUT_SECONDS = 30
LEASE_MAX_ATTEMPTS = 3

THIN_README_TOKENS = 50
THIN_README_SCORE = 0.35
README_SCORE_LINEAR_TOKENS = 50.0
README_SCORE_LOG_TOKENS = 400

EVAL_K_DEFAULT = 10
EVAL_K_MAX = 50
SEARCH_LIMIT_DEFAULT = 30
SEARCH_LIMIT_MAX = 100
SAMPLE_ROWS_DEFAULT = 100
SNIPPET_CHARS = 200
ROW_TEXT_CHARS = 20000
JOB_ERROR_DETAIL_CHARS = 2000
EVENT_ERROR_DETAIL_CHARS = 500
BACKFILL_DAYS = (1, 3, 7)

# Published BM25 defaults.
BM25_K1 = 1.2
BM25_B = 0.75

# What counts as white space and as a line end in text input.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Analysed terms are runs of letters, digits and underscores.
NON_TERM = r"[^\p{L}\p{N}_]+"
