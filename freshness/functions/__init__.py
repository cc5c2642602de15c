"""Column functions and user-function forms."""
