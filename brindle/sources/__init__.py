"""Reading and writing of single-file databases."""
