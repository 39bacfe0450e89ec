"""Joins of a keyed relation with one that refers to it, planned by how often each key is referred to, and what belongs around them."""
