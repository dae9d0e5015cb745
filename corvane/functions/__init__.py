"""Column functions of the text and signal library."""
