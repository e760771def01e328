"""Spark jobs for document question answering: text statistics, chunks, retrieval, answers and analytics."""
