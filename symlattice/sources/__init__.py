"""Readers: project trees, sessions, skills and tables."""
