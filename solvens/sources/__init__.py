"""Table readers, writers and the tables derived from them."""
