"""Parsers of whole source files: recursive descent over statements, precedence climbing over expressions."""
