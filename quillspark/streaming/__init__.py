"""The ledger as a stream: records arrive, verdicts are counted as they come."""
