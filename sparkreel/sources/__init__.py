"""Readers of stage documents and recognizer output; stage tables."""
