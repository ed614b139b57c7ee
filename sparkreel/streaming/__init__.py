"""Picking up new transcripts."""
