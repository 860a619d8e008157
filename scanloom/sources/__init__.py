"""Readers and writers, stage folders, and the fixture relations."""
