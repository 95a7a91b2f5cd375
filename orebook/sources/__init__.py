"""Readers: files, tables and JSON payloads to DataFrames."""
