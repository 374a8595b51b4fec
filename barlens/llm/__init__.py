"""Operators for preparing training data from raw documents, pages and vectors."""
