"""Readers: files, landed API responses, JDBC, object inventory."""
