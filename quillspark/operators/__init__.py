"""DataFrame operators on experiment ledgers."""
