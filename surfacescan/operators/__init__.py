"""Operators over files, segments, syntax nodes and findings."""
