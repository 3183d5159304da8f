"""Target-exact conversational search datasets on Spark, and corpus operators.

Functions that run inside Spark tasks are pickled with the code of this package,
so executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
