"""Training-data operators: each module holds one operator and its query.

Nothing outside this subpackage (and the pipeline script at the repository
top) imports it.
"""
