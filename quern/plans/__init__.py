"""Composed plans: the queries a user runs end to end."""
