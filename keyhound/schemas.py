"""Schemas of the tables that flow through a scan."""

FILES_SCHEMA = "path STRING, length BIGINT, content BINARY"
LINES_SCHEMA = "path STRING, line INT, text STRING"
KV_SCHEMA = "file_path STRING, key STRING, value STRING, kv_path STRING, line INT"
ERRORS_SCHEMA = "file_path STRING, format STRING, message STRING"

_MATCH_CONFIG = (
    "STRUCT<regex: STRING, ignorecase: BOOLEAN, minlen: INT, is_base64: BOOLEAN, "
    "is_uri: BOOLEAN, is_luhn: BOOLEAN, is_ascii: BOOLEAN>"
)
RULE_SCHEMA = (
    "rule_order INT, rule_id STRING, description STRING, message STRING, severity STRING, "
    f"similar DOUBLE, key {_MATCH_CONFIG}, value {_MATCH_CONFIG}"
)

KV_COLUMNS = ["file_path", "key", "value", "kv_path", "line"]
FINDING_COLUMNS = ["RuleID", "Description", "FilePath", "LineNumber", "Content", "Severity"]

# What one extractor emits for one line or one document.
KV_ITEM = "STRUCT<key: STRING, value: STRING, kv_path: STRING>"
KV_ITEMS = f"ARRAY<{KV_ITEM}>"
