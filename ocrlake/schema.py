"""Tables of the catalog and the invariants their columns keep."""

from __future__ import annotations

SCHEMA_VERSION = 5

FOLDERS = "id long, path string, enabled int, is_recursive int, created_at timestamp, updated_at timestamp, last_scanned_at timestamp"
ITEMS = (
    "id long, folder_id long, path string, filename string, extension string, file_size long, modified_at_fs string, content_hash string, "
    "width int, height int, ocr_text string, ocr_status string, ocr_engine string, ocr_engine_version string, ocr_language string, "
    "ocr_pipeline_version string, indexed_at timestamp, created_at timestamp, updated_at timestamp"
)
JOBS = (
    "id long, folder_id long, screenshot_id long, path string, job_type string, status string, dedupe_key string, attempts int, max_attempts int, "
    "available_at timestamp, lease_until timestamp, last_error_code string, last_error_message string, created_at timestamp, updated_at timestamp, completed_at timestamp"
)
VECTORS = "screenshot_id long, model_id string, model_version string, embedding array<float>, created_at timestamp"

PENDING, PROCESSING, SUCCEEDED, FAILED = "PENDING", "PROCESSING", "SUCCEEDED", "FAILED"
UPSERT_JOB, DELETE_JOB, EMBED_JOB, RE_OCR_JOB = "UPSERT_SCREENSHOT", "DELETE_SCREENSHOT", "GENERATE_TEXT_EMBEDDING", "RE_OCR_SCREENSHOT"


class EngineError(Exception):
    """A failure with a stable code."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
