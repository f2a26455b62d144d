"""Readers, sinks and the folder for intermediate tables."""
