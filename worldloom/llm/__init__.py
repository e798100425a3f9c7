"""Operators over text corpora and mail for training data.  Nothing outside this folder imports it."""
