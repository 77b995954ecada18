"""Shared plan shapes: skew-safe lookups and the order/seller grain."""
