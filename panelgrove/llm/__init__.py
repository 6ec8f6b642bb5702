"""Operators for preparing text corpora that language models are trained on."""
