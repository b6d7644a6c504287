"""Readers, writers and catalog look-ups."""
