"""Operators for text corpora and record curation; nothing outside this folder imports it."""
