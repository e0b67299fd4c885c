"""Training-data operators: each module holds one operator with its own interface.

``registry`` derives the thin ``opN_`` queries from them.  Nothing outside this
subpackage imports it.
"""
