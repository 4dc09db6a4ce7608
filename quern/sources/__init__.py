"""Readers that turn stored tables and files into engine tables."""
