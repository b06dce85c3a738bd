"""Readers, sinks, the dataset memory and the derived email tables."""
