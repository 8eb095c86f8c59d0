"""Readers of notes and tables."""
