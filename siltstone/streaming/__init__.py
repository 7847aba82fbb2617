"""Structured Streaming forms of the stateless and stateful operators."""
