"""Retrieval models, ranking, feedback, reranking, evaluation and inspection."""
