"""Corpus, table and evaluation-set readers and the index store."""
