"""Readers and writers: log lines, nested documents, stem folders, signal files, cache tables."""
