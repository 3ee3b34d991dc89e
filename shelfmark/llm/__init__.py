"""Training-data operators: ten components for building text corpora at cluster scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and column
names and returns a DataFrame with a fixed schema; ``queries`` derives the digest columns
of the registered ``opN_*`` queries from the operators' real outputs.
"""
