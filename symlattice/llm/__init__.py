"""Operators that prepare training data; each module holds one operator."""
