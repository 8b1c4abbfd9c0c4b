"""Training-corpus operators: quality, duplicates, leaks, tokens, mixing and sharding of text at scale.

Nothing outside this subpackage imports it.
"""
