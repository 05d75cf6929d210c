"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it; ``queries`` holds the registry that
the repository's entry module adds when the folder is present.
"""
