"""Structured Streaming jobs: job intake and the audit log."""
