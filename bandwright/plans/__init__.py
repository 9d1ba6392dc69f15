"""Frames, end-to-end flows and the query catalogue over the given tables."""
