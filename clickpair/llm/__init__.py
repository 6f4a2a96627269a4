"""Operators of a training-data pipeline, as Spark jobs over ``documents``,
``labels`` and ``conversations``.  Nothing else in the library imports this
subpackage."""
