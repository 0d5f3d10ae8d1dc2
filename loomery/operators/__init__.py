"""Operators over DataFrames: what columns hold, how they are shaped, and which values must not come back."""
