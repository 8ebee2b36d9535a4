"""Column functions and relational forms of value encodings."""
