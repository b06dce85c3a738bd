"""Structured Streaming forms of intake, de-duplication and scoring."""
