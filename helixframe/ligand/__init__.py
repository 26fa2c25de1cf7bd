"""Small molecules."""
