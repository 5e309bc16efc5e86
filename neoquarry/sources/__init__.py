"""Readers for the file kinds the operators take in, and writers for their results."""
