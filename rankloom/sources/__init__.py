"""Readers of corpora, queries, judgements and runs, and writers of their products."""
