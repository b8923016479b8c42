"""Contracts compiled to one lazy plan."""
