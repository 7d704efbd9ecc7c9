"""Operators for training corpora: one module per operator, ``queries`` registers them."""
