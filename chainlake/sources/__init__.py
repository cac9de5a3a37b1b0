"""Readers and writers of sequence, structure and score files."""
