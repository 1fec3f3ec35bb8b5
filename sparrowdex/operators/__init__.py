"""Operators over an index: build, search, maintain, describe."""
