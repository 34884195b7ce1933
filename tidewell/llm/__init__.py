"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it depends only on
PySpark, pyarrow and numpy plus the public tokenizer libraries.
"""
