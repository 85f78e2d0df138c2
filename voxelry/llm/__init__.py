"""Operators for preparing language-model training data, on Spark DataFrames.

Nothing outside this folder imports it; ``queries`` holds what the entry module registers.
"""
