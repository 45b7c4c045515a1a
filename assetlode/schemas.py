"""Closed value sets, limits and table keys of the inventory."""

from __future__ import annotations

# Fixed values, in their natural order.
ANALYSIS_STATES = ("pending", "running", "done", "partial", "failed")
TERMINAL_STATES = ("done", "partial", "failed")
RETRYABLE_STATES = ("partial", "failed")
SCAN_STATES = ("running", "suspended", "completed", "discarded")
SUSPEND_REASONS = ("operator_paused", "project_changed", "process_restarted", "retention_eviction")
PRODUCIBILITY = ("producible", "gone", "changed")
REJECT_REASONS = ("status", "revalidation", "empty", "too_large", "not_scriptish", "out_of_scope")
MAP_REFUSALS = ("too_large", "too_deep", "too_many_sources", "malformed_json", "malformed_base64", "nested_sections", "not_a_map", "empty")
CATEGORIES = ("artifacts", "observations", "analyses", "sources", "source_sightings")
EXPORT_TABLES = ("artifacts", "observations", "sources")
EXPORT_FORMATS = ("csv", "json")
EXPORT_MODES = ("redacted", "raw")
AUDIT_KINDS = ("export", "scan_discarded", "scan_suspended", "retention", "setting_written", "setting_cleared", "retry", "loss_detected", "producibility")

MAX_BODY_BYTES = 8_388_608
MAX_MAP_BYTES = 2_621_440
MAP_ROW_BUDGET = 2_048
PAGE_MAX, CANDIDATE_WINDOW = 100, 500
EXPORT_CHUNK, TREE_ROWS = 20_000, 2_000
SWEEP_DELETES, VICTIM_LIMIT = 512, 1_024
URL_MAX, QUERY_NAME_MAX, LABEL_MAX, ERROR_MAX = 2_048, 64, 4_096, 240
FRAME_BYTES, FRAME_OVERLAP = 65_536, 4_096
QUEUE_CAPACITY, BURST_RESERVE, SCAN_PAGE = 2_048, 500, 20
DEFAULTS = {"row_cap": "50000", "max_age_days": "90", "audit_cap": "200000"}
DAY_MS = 86_400_000

SCRIPT_MEDIA_TYPES = (
    "application/ecmascript", "application/javascript", "application/x-ecmascript", "application/x-javascript",
    "text/ecmascript", "text/javascript", "text/javascript1.0", "text/javascript1.1", "text/javascript1.2",
    "text/javascript1.3", "text/javascript1.4", "text/javascript1.5", "text/js", "text/jscript", "text/livescript",
    "text/x-ecmascript", "text/x-javascript",
)
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue", ".css", ".scss", ".json", ".md")
LOG_SIGNALS = {
    "interrupt": r"interrupt",
    "timeout": r"timed?.?out|timeout",
    "regexp_error": r"RegExp|regex.*(too|limit|abort)",
    "stack_overflow": r"stack overflow|Maximum call stack",
    "abort_assertion": r"ref_count|gc_decref|Assertion failed|panicked|SIGABRT",
    "out_of_memory": r"out of memory|OutOfMemory|OOM",
}

KEYS = {
    "artifacts": ("project_id", "sha256"),
    "observations": ("project_id", "sha256", "request_id"),
    "analyses": ("project_id", "sha256", "detector_set_hash"),
    "settings": ("project_id", "key"),
    "audit": ("project_id", "event_id"),
    "scans": ("project_id", "scan_id"),
    "sources": ("project_id", "source_sha256"),
    "source_sightings": ("project_id", "artifact_sha256", "map_sha256", "source_index"),
}
