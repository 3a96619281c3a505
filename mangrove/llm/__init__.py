"""Training-data operators: ten corpus operators on a ``documents`` DataFrame.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries.py`` holds the thin digest queries.
"""
