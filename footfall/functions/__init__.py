"""Column expressions: time handling, hit keys and display labels."""
