"""Operators for preparing language-model training data, each a set of Spark jobs."""
