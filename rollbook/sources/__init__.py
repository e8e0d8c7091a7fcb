"""Readers, writers and message codecs."""
