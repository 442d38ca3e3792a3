"""Relational operators: DataFrames in, DataFrames out, nothing executed eagerly unless said so."""
