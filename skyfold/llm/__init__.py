"""Operators for text corpora and embeddings.  Nothing outside imports this."""
