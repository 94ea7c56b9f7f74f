"""Operators over tables of documents, lines, pages and images."""
