"""Reading and writing stores as files."""
