"""Lexweave: document translation, verification and corpus work on Spark DataFrames."""
