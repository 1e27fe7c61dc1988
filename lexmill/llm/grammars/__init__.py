"""Parsing-expression grammars of the source languages, one module each."""
