"""Operators for preparing language-model training data, and the queries registered for them."""
