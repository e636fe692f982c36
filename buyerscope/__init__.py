"""Customer-propensity analytics expressed as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helpers of this package that run inside tasks travel with the task, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
