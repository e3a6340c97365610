"""Training-data operators over documents, embeddings and conversations, and their queries (``queries.py``)."""
