"""Readers of office files, mail and text lines."""
