"""Operators for preparing training data at large scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
