"""clickpair: Spark-native short-text pair matching and click-rate features.

Every public operator takes and returns a DataFrame (or a Column for the
pure expression helpers in ``clickpair.functions``).  Nothing is collected
to the driver; the optimizer sees one lazy plan per query.
"""

from clickpair.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
