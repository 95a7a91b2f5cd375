"""Operators for training-data pipelines: tokens, duplicates, language, licences, lists, personal data, shards."""
