"""From statement text to a logical plan: lexer, syntax tree and parser."""
