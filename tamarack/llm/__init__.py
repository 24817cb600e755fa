"""Operators that prepare text collections for the training and evaluation of language models."""
