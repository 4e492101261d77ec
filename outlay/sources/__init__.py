"""Readers for landed extracts, and the filters applied right after reading."""
