"""Readers for the raw JSON documents and stored tables, and the writers."""
