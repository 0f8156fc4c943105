"""Statements that arrive as a stream, answered by the same compiled plan as batches: an extension of the catalogue."""
