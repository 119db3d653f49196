"""Streaming forms of the stateful transforms."""
