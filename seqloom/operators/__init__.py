"""Operators on ordered sequences and intervals."""
