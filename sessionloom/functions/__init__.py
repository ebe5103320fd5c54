"""Column functions over transcript text."""
