"""Corpus-preparation operators. Nothing outside this subpackage imports it."""
