"""Operators for text corpora and vectors; nothing else in the library imports this subpackage."""
