"""Indexes that grow with a stream of documents."""
