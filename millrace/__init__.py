"""Dataflow operators as DataFrame, SQL and Structured Streaming plans."""
