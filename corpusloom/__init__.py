"""Corpus analytics and tokenizer induction on Spark DataFrames."""

__version__ = "0.1.0"
