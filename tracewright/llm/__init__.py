"""Operators for large text collections used as training data.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries where it can be imported.
"""
