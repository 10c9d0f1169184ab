"""Readers and writers: session logs, corpora, settings, traces, rendered pages."""
