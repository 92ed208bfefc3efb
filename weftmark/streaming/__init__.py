"""Analyses of documents as they arrive."""
