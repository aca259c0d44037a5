"""Operators for preparing training data, one module each; see the README's list."""
