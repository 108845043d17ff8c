"""Fixed values that results depend on."""

# --- fixed values: prose and table chunking -------------------------------
CHUNK_TOKENS = 512
CHUNK_OVERLAP_TOKENS = 50
TOKENS_PER_WORD = 1.3
TABLE_WORD_LIMIT = 1150
TABLE_GROUP_LINES = 20

# --- fixed values: retrieval ----------------------------------------------
TOP_K_RETRIEVE = 20
TOP_K_RERANK = 5
EMBED_BATCH = 10

# --- fixed values: conversation memory ------------------------------------
WINDOW_TURNS = 4
SUMMARIZE_AFTER_TURNS = 8
WINDOW_MESSAGE_CHARS = 600
SUMMARY_MESSAGE_CHARS = 500

# --- fixed values: uploads ------------------------------------------------
ALLOWED_EXTENSIONS = ("pdf", "csv", "xlsx", "xls")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
FINGERPRINT_BLOCK_BYTES = 128 * 1024 * 1024  # a power of two
COLUMN_NAME_CHARS = 63

# --- fixed values: governed SQL -------------------------------------------
ROW_CAP = 500
SYSTEM_TABLES = ("pg_catalog", "information_schema", "pg_tables", "pg_class", "pg_namespace")

# --- fixed values: audit --------------------------------------------------
PROMPT_VERSION = "v1.0"
AUDIT_PAGE_ROWS = 50
RECENT_SESSIONS = 20
REPORT_BODY_CHARS = 2000
REPORT_CODE_CHARS = 1000
REPORT_CHUNK_CHARS = 400
REPORT_SQL_QUERIES = 3
REPORT_CHUNKS = 5
DECISION_ACTIONS = ("accept", "reject", "review")
JSON_ATTEMPTS = 3
CONFIDENCE_LEVELS = ("high", "medium", "low")

# --- fixed values: tokens a CSV reader takes for "missing" (pandas) --------
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: upper bounds of request latency histograms (seconds,
# the client library's defaults) -------------------------------------------
LATENCY_BUCKETS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)
