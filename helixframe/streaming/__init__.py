"""Measures over frames that arrive as a stream."""
