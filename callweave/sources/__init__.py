"""Readers of lists, transcripts, fixtures, paged listings and signed payloads."""
