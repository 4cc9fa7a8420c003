"""Operators for text corpora and vectors used to train language models. Nothing else in the library imports this."""
