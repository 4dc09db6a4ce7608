"""Artifacts: what a run, an index or a document leaves behind."""
