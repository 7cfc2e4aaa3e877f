"""Whole queries: regrading, experiment summaries, dictionary builds, headline checks, and the driver's query set."""
