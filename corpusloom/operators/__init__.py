"""Operators on documents, cards, entities and history tables."""
