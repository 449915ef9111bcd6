"""Structured Streaming forms of intake and the job state machine."""
