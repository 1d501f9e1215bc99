"""Operators for preparing language-model training data.

Self-contained: no other module of the library imports this subpackage.
"""
