"""Text and embedding operators for preparing training data.

Nothing outside this package imports it. Operators take and return DataFrames;
`queries` holds the thin queries built on them.
"""
