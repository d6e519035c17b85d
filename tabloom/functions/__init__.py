"""Functions over names and columns that operators are made of."""
