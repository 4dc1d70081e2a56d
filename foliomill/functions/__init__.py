"""Functions of the corpus library."""
