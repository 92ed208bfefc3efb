"""Operators from documents to tokens, fingerprints, pairs and fragments."""
