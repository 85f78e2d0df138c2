"""Readers, writers and rasters."""
