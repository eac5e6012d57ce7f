"""Whole plans: a scan from files to findings, and a project scan on stored tables."""
