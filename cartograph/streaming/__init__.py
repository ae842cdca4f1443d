"""Streaming entry points: none. The engine answers batch requests; a stream is profiled or queried through its tables."""
