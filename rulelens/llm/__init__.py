"""Operators for preparing the training data of language models."""
