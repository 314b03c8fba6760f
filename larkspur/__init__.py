"""A relational-algebra engine on PySpark."""
