"""Operators for training data made of language text. Nothing outside this subpackage imports it."""
