"""Scans and sinks of experiment ledgers, task banks, codebooks and frames."""
