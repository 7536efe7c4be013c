"""Operators for training-data pipelines over ``documents``, ``pages`` and ``embeddings``.

Nothing else in the package imports this one. ``registry`` holds the queries.
"""
