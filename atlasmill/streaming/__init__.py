"""Structured Streaming forms of the request limiter and the decision queue."""
