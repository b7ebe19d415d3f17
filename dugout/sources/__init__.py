"""Reading landed files and writing stage tables."""
