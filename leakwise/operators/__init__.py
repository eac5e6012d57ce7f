"""Relational operators over files, findings, exceptions, scans and scores."""
