"""Readers and writers: catalog, documents, payloads, run logs, keyed tables."""
