"""Operators for training-data corpora: cleaning, copies, mixing, search, formatting."""
