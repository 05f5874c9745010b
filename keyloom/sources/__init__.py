"""Readers, writers and generators of relations."""
