"""Operators over relations."""
