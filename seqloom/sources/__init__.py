"""Readers and writers of the formats around sequences and intervals."""
