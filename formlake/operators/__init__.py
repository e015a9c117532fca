"""Relational operators over results, feature tables and race cards."""
