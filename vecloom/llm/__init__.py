"""Operators for building training corpora: archives, search, near-copies, mixing, language, quality, token files, leaks, privacy."""
