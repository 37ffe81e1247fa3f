"""Operators on Structured Streaming, each beside its batch form."""
