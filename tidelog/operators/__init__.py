"""Operators over the mutation log."""
