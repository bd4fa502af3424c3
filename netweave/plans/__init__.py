"""Registered queries: what ``__spark_entry__`` exposes."""
