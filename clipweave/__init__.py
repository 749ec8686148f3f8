"""Spark-native analytics for time-coded footage.

Worker-side functions of this package are pickled by value, so executors need only
pyspark, pandas, pyarrow and numpy, not an installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
