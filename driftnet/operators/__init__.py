"""Relational operators over the catalog: reads, mutations, search, enrichment, key space."""
