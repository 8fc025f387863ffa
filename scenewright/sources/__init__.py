"""Readers and writers for tilesets, levels, samples and training logs."""
