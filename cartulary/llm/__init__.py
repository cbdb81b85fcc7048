"""Operators that prepare text for training; nothing else in the package imports them."""
