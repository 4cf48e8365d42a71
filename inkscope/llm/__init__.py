"""Training-data operators: ten corpus operations and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it is present.
"""
