"""Operators of a training-data pipeline: secrets, quality, tokenising, language, pages, toxicity, copies, PII."""
