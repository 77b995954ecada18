"""Readers, sinks and view registration."""
