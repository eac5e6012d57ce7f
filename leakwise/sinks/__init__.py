"""Sinks: CSV, SARIF, lines of JSON, editor diagnostics, summaries and webhooks."""
