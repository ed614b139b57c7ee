"""Highlight discovery and clip planning over tables of timed transcripts, as Spark DataFrame jobs."""
