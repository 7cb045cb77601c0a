"""Structured Streaming: draining of spool segments, growth windows, state by key."""
