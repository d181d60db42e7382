"""Readers and writers: CSV, JSON, Dataset-JSON, form exports, logs, findings."""
