"""Corpus and event-study analytics over corporate disclosures, on Spark."""
