"""Parsers built from the grammars bundled here: a packrat table over a token stream, one per language."""
