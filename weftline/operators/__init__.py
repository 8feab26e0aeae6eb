"""Dataflow operators over hits, runs, cache entries and text spans."""
