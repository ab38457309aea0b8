"""Training-data operators: each module is one operator with its own general interface.

Nothing outside this package imports it; it can be deleted as a whole.
"""
