"""Column functions: value cleaning, parsing, and text formatting."""
