"""Operators that prepare a training corpus for a language model. Nothing else in the library imports them."""
