"""Readers that give rows with evidence, and writers."""
