"""Time-series analytics on Spark DataFrames.

Every operator is a function from DataFrame to DataFrame, keyed by a series id,
so the same plan serves one very long series or very many short ones.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The Python functions of this package travel to the executors by value, so no
# copy of the package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
