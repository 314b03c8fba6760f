"""XML documents as relations, and path queries over them."""
