"""Text-corpus, retrieval, answer-audit and operations analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The small helpers that run inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "sources", "streaming", "plans", "session", "schemas"]
