"""Operators for building training data: each module holds one operator and its thin query."""
