"""Streaming forms of sessions, idempotent ingest and the failure breaker."""
