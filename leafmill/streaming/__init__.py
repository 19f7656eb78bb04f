"""Incremental work: streams of chunks and events."""
