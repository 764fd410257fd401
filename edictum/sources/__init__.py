"""Scans, generated data, shared tables and the step store."""
