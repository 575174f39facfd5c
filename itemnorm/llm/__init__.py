"""Operators for building training data from documents, pages, conversations and embeddings."""
