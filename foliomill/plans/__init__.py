"""Plans of the corpus library."""
