"""Corpora, indexes, and the text formats that queries, runs, judgements and metrics come in."""
