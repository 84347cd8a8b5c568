"""Explicit schemas of the engine's tables; nothing is inferred from data."""

FILES = "rel_path string, ext string, size_bytes long, mtime_ms long, content string"
ISSUES = "app_id long, scan_id long, file string, line int, severity string, category string, summary string, suggested_fix string, source string"
TRIAGE = "app_id long, fingerprint string, state string, note string, assignee string, updated_at timestamp"
RULES = "rule_id int, category string, pattern string, reason string, expires_at timestamp, created_by string"
IGNORES = "pattern_id int, pattern string, reason string, expires_at timestamp, created_by string"
SNAPSHOTS = "app_id long, scan_id long, scanned_at timestamp, duration_ms double"
CACHE = "app_id long, rel_path string, size_bytes long, mtime_ms long, content_sha1 string, version string, result string"
AUDIT = "kind string, action string, app_id long, rule_id int, reason string, by string, at timestamp"

#: Severities from worst to least, triage states, and those that dismiss a finding.
SEVERITIES = ["Critical", "High", "Medium", "Low"]
STATES = ["open", "acknowledged", "false_positive", "fixed"]
DISMISSED = ["false_positive", "fixed"]
