"""Readers and writers for fetched pages and for the stored collections."""
