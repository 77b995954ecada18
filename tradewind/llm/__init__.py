"""Operators of a training-data pipeline: one module each, general interface, any table of texts."""
