"""Catalog operators: offers and price history."""
