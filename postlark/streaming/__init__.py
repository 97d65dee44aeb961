"""Postings and feedback as streams: an extension, in which watermarks bound what a batch run bounds by counts."""
