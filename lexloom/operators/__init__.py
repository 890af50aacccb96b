"""Relational operators over ops, texts, catalogs and images."""
