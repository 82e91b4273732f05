"""Operators for building language-model training data; nothing else in ``symtab`` imports this subpackage."""
