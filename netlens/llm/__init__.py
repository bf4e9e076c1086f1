"""Operators of a training-data pipeline: tokens, search, deduplication, language, secrets, mixing, privacy, decontamination."""
