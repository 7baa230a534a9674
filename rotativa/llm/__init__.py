"""Operators for the text of training data; nothing else in the library imports them."""
