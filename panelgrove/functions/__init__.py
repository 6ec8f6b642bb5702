"""Factor operators on price panels."""
