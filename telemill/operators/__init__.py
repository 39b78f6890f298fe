"""Operators on observations, events and the entity graph."""
