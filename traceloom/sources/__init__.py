"""Readers and writers of trace logs, run documents, datasets and registry tables."""
