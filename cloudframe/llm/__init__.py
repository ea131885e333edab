"""Operators for preparing training text: thirteen corpus operators and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
