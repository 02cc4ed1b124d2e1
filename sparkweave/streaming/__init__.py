"""Structured Streaming pieces: topics, change-data-capture landing, monitors."""
