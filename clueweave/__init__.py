"""Lexical-graph and word-puzzle analytics expressed as Spark DataFrame plans."""
