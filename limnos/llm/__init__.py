"""Operators for building training data out of text corpora, web pages and conversations."""
