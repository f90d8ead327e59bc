"""Spark-native analytics for text corpora and model evaluation.

The package is pickled by value, functions and what they use, so that a cluster
needs nothing installed besides PySpark, pyarrow, pandas and numpy.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__: list[str] = []
